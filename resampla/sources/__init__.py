"""Tables and the analysis frames derived from them."""

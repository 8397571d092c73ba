"""Statistical operators: resampling, linear and logistic tests, confounder search, reports."""

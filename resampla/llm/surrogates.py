"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern of alternatives, so they never overlap: e-mail addresses, IPv4 and IPv6
addresses, phone, social security and card numbers, IBANs, access keys and labelled secrets, and names after a form
of address or a label such as ``Patient:``, before an address in angle brackets, in small letters after one in small letters
where a listed given name leads, and in Chinese characters beside a form of address.
In a text with such a name, its words are entities wherever they stand alone with a capital, too, but for ``ORDINARY``
words: months, days and words that begin sentences.  The parts of a hyphened name are words of their own.  Each gets a replacement derived from a secret key, the entity's type and its normal form,
so every mention gets the same one in every document.  Replacements keep the type and the format:
punctuation and length of numbers, valid octets, the issuer digit of cards and the country of IBANs, check digits
where they held, hexadecimal secrets, the top domain, upper and lower case, and for names the gender (from the form of
address, or where that has none from a list of given names, else neither) and the script.  Names are replaced word by word, so "Mr John Reed" and a later "Mr Reed" keep
the surname in common.  One domain name maps to one domain name.

*Collision checks.*  All distinct entities are gathered; replacements that equal another's, or a real entity of
the type, are drawn anew until none is left, so distinct entities stay distinct and no real one is
named.  A name drawn anew grows by a syllable with each round of draws.  Mailboxes and secrets keep their length for
``SAME`` rounds and grow by a character with each after, so a full format becomes a wider one.  Numbers keep their
format: phone and social security numbers that the draws leave unsettled get the format's free values, in the order of
keyed hashes.  Only a format with fewer free values than that raises an error.

Texts without entities are never shuffled.  The other documents' replacements are broadcast only while
they are few (``broadcast_rows``), else joined by id.  Null and empty texts stay as they are, with no entities.
Repeated rows, also ones that share an id, are each replaced by their own text.  Extra columns are kept, but one named as
the count is replaced by it.  An empty table gives no rows.  Patterns start only where a run of their characters does, and have
bounds wherever a group repeats, so that the time is in proportion to a text whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resampla.llm.common import materialize

# Forms of address, by gender, and given names that tell it where the form doesn't.
MALE = ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Don", "Signor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "Signora", "Госпожа"]
EITHER = ["Dr", "Prof", "Professor", "Doctor", "Доктор", "Профессор"]
WOMEN = "mary anna ann anne maria elena laura emma julia sophie sarah susan linda karen lisa nancy helen ruth alice eva clara marie claire camille carmen lucia ana isabel greta heike petra monika olga irina tatiana анна мария елена ольга ирина татьяна наталья светлана".split()
MEN = "john james robert michael david william thomas peter paul mark george charles henry jack hans karl klaus jürgen wolfgang stefan pierre jean jacques michel luc josé juan carlos luis pedro miguel ivan boris sergei dmitri иван пётр сергей дмитрий алексей николай борис михаил".split()
TITLES = [*FEMALE, *MALE, *EITHER]
SMALL = ["mr", "mrs", "ms", "miss", "dr", "prof"]
LABELS = ["Patient", "Name", "Contact", "Customer", "Client", "Employee", "Applicant", "Sender", "Recipient", "Signed"]
HAN_TITLES = ["先生", "女士", "小姐", "教授", "博士", "医生"]
ORDINARY = "i a an the he she it we you they his her its our your their this that these those what who when where why how and or but if so as at by for from in of on to with not no yes is are was were be been has have had do does did will may might can could shall should would must march april june july august january february september october november december monday tuesday wednesday thursday friday saturday sunday dear hello hi regards best".split()
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
WORD = r"\p{Lu}\p{L}*+(?:['’-]\p{L}{2,}+){0,3}+"
HEX = "[0-9A-Fa-f]{1,4}"
TITLE = r"(?:(?:" + "|".join([*TITLES, *SMALL]) + r")\.?|(?:" + "|".join(LABELS) + r"):) "  # what may stand before a name
PLAIN = r"(?!(?i:" + "|".join(ORDINARY) + r")(?!\p{L}))"  # no ordinary word begins here
HAN = r"\p{IsHan}{2,4}"
NAMES = [
    rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|(?:{'|'.join(LABELS)}):) {WORD}(?: {WORD}){{0,2}}+",
    rf"(?<!\p{{L}})(?:{'|'.join(SMALL)})\.? (?:{'|'.join(WOMEN + MEN)})(?!\p{{L}})(?: {PLAIN}\p{{Ll}}{{3,}}+)?+",
    rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? {HAN}(?!\p{{IsHan}})",
    rf"(?<!\p{{IsHan}})\p{{IsHan}}{{2,4}}?(?={'|'.join(HAN_TITLES)})",
    rf"(?<!\p{{L}}){PLAIN}{WORD}(?: {WORD}){{1,2}}+(?= <[A-Za-z0-9._%+-]{{1,256}}+@)",
]
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,256}+@(?:[A-Za-z0-9-]{1,63}+\.){1,100}[A-Za-z]{2,}+",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]{{0,40}}\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2} ?[A-Z0-9]{4} ?\d{4}(?: ?\d{3}|(?: ?\d{4}){1,5}(?: ?[A-Z0-9]{1,3})?)(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "key": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "secret": r"(?i:(?<!\w)(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d|pwd)[\"']?\s*+[=:]\s*+[\"']?)[A-Za-z0-9_\-/+]{8,}+",
    "name": "|".join(NAMES),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
BARE = rf"(?<![\p{{L}}\p{{N}}_])(?:{WORD})"  # a capitalised word, looked at only in texts with names
SAME = 8  # rounds of draws of a mailbox or secret before it grows
LATIN = ["ba", "den", "fer", "gol", "har", "ki", "lan", "mor", "nel", "per", "ros", "san", "tor", "vel", "wen", "zan"]
HAN_PARTS = list("安柏晨东帆光海嘉康林明宁平清荣山")
CYRILLIC = ["ба", "ден", "фер", "гол", "хар", "ки", "лан", "мор", "нел", "пер", "рос", "сан", "тор", "вел", "вен", "зан"]


def may_hold(text: Column) -> Column:
    """False only for texts in which no pattern can match: plain searches, far cheaper than the patterns."""
    return contains_any(text, ["@", *"0123456789", "AKIA", "ASIA", "=", ":"]) | may_name(text)


def contains_any(text: Column, needed: list[str]) -> Column:
    out = text.contains(needed[0])
    for x in needed[1:]:
        out = out | text.contains(x)
    return out


def may_name(text: Column) -> Column:
    return contains_any(text, [*(f"{x}{end}" for x in [*TITLES, *SMALL] for end in (" ", ".")), *(f"{x}:" for x in LABELS), " <", *HAN_TITLES])


def by_names(text: Column, of) -> Column:
    """``of`` the pattern for the text: with single capitalised words where it has a name."""
    named = may_name(text) & text.rlike(PATTERNS["name"])
    return F.when(named, of(f"{ANY}|{BARE}")).otherwise(of(ANY))


def kind_of(hit: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        whole = hit.rlike(rf"\A(?:{pattern})\z")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    out = out.when(hit.rlike(rf"\A{WORD}(?: {WORD}){{1,2}}\z") | hit.rlike(rf"\A{HAN}\z"), "name")  # what followed it is not in the hit
    return out.when(hit.rlike(rf"\A{WORD}\z"), "bare").otherwise("secret")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def normal(kind: Column, hit: Column) -> Column:
    """The form that all mentions of an entity share; for names see ``atoms``."""
    number = kind.isin("ssn", "phone", "card")
    value = F.regexp_extract(hit, r"([A-Za-z0-9_\-/+]+)\z", 1)
    return F.when(kind.isin("email", "ip6"), F.lower(hit)).when(kind == "iban", F.replace(hit, F.lit(" "), F.lit(""))).when(number, digits(hit)).when(kind == "secret", value).otherwise(hit)


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def number_at(seed: Column, i: Column, below: int) -> Column:
    """The i-th number of the stream of a 128-digit hexadecimal seed."""
    at = (F.pmod(i * 3, F.lit(124)) + 1).cast("int")
    return F.pmod(F.conv(F.substr(seed, at, F.lit(4)), 16, 10).cast("long"), F.lit(below)).cast("int")


def shaped(x: Column, seed: Column) -> Column:
    """Each digit, small and capital letter replaced by another of its class."""

    def swap(c, i):
        letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), number_at(seed, i, 26) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), number_at(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(chars(x), swap), "")


def luhn(x: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""

    def term(c, i):
        v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.reverse(chars(x)), term), F.lit(0), lambda a, b: a + b) % 10


def mod97(x: Column) -> Column:
    """A string of digits and capitals (10 to 35) modulo 97."""

    def step(rest, c):
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(chars(x), F.lit(0), step)


def seed_of(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), value), 512)


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Replacement of a normal form."""
    seed = seed_of(key, kind, value, attempt)
    local, domain = F.regexp_extract(value, r"\A([^@]*)@", 1), F.regexp_extract(value, r"@(.*)\.[^.]*\z", 1)
    more = F.substring(seed, F.lit(1), F.greatest(attempt - SAME, F.lit(0)))
    email = F.concat(shaped(local, seed), more, F.lit("@"), shaped(domain, seed_of(key, F.lit("domain"), domain, F.lit(0))), F.regexp_extract(value, r"(\.[^.]*)\z", 1))
    ip = F.concat_ws(".", (number_at(seed, F.lit(0), 223) + 1).cast("string"), *[number_at(seed, F.lit(i), 256).cast("string") for i in (1, 2, 3)])
    drawn = shaped(value, seed)
    phone = F.when((F.length(value) == 11) & value.startswith("1"), F.concat(F.lit("1"), (number_at(seed, F.lit(40), 8) + 2).cast("string"), F.substr(drawn, F.lit(3)))).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2))))
    ip6 = F.concat_ws(":", *[F.substring(seed, 4 * i + 1, 4) for i in range(8)])
    country, account = F.substring(value, 1, 2), shaped(F.substr(value, F.lit(5)), seed)
    sound = mod97(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))) == 1
    digits_of = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(sound, digits_of).otherwise(shaped(F.substring(value, 3, 2), seed_of(key, kind, value, attempt + 1000))), account)
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substring(drawn, F.lit(2), F.length(value) - 2))
    check = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, F.when(luhn(value) == 0, check).otherwise(F.substr(drawn, F.length(value), F.lit(1))))
    hexadecimal = F.when(value.rlike(r"\A[0-9a-f]{8,128}\z"), F.substring(seed, F.lit(1), F.length(value)))
    secret = hexadecimal.when(value.rlike(r"\A[0-9A-F]{8,128}\z"), F.upper(F.substring(seed, F.lit(1), F.length(value)))).otherwise(drawn)
    secret = F.concat(secret, F.when(value.rlike(r"\A[0-9A-F]{8,128}\z"), F.upper(more)).otherwise(more))
    access = F.concat(F.substr(value, F.lit(1), F.lit(4)), shaped(F.substr(value, F.lit(5)), seed))
    names = {}
    for script, parts, female, male, either in (("latin", LATIN, ["a", "ia", "ina"], ["o", "us", "ek"], ["e", "i", "y"]), ("cyrillic", CYRILLIC, ["а", "ия", "ина"], ["ий", "ек", "ан"], ["е", "и", "ю"])):
        part = lambda i, p=parts: F.element_at(F.array(*map(F.lit, p)), number_at(seed, i if isinstance(i, Column) else F.lit(i), len(p)) + 1)
        end = lambda e, i: F.element_at(F.array(*map(F.lit, e)), number_at(seed, F.lit(i), len(e)) + 1)
        grown = F.array_join(F.transform(F.sequence(F.lit(5), attempt + 5), lambda i: F.when(i > 5, part(i)).otherwise("")), "")  # noqa: B023
        names[f"given_f_{script}"] = F.concat(part(0), part(1), part(2), grown, end(female, 3))
        names[f"given_m_{script}"] = F.concat(part(0), part(1), part(2), grown, end(male, 3))
        names[f"given_n_{script}"] = F.concat(part(0), part(1), part(2), grown, end(either, 3))
        names[f"surname_{script}"] = F.concat(part(0), part(1), part(2), part(3), part(4), grown)
    han = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: F.element_at(F.array(*map(F.lit, HAN_PARTS)), number_at(seed, i, len(HAN_PARTS)) + 1)), "")
    out = F.when(kind == "email", email).when(kind == "ip6", ip6).when(kind == "iban", iban).when(kind.endswith("_han"), han).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "key", access).when(kind == "secret", secret)
    for k, v in names.items():
        out = out.when(kind == k, v)
    return out.otherwise(drawn)


def atoms(hit: Column, kind: Column) -> Column:
    """Entities of a hit: itself, or each word of a name with gender and script."""
    name = F.regexp_replace(hit, rf"\A{TITLE}", "")
    words = F.split(name, "[ -]")
    title = lambda x: hit.rlike(r"\A(?i:" + "|".join(x) + r")\.? ")
    last = F.size(words) - F.size(F.split(F.element_at(F.split(name, " "), -1), "-"))  # where the surname begins

    def atom(w, i):
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsHan}"), "han").otherwise("latin")
        gender = F.when(title(FEMALE), "f").when(title(MALE), "m").when(F.lower(words[0]).isin(WOMEN), "f").when(F.lower(words[0]).isin(MEN), "m").otherwise("n")
        return F.struct(F.when(i >= last, F.concat(F.lit("surname_"), script)).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), script)).alias("kind"), F.lower(w).alias("norm"), w.alias("raw"))

    one = F.array(F.struct(kind.alias("kind"), normal(kind, hit).alias("norm"), hit.alias("raw")))
    parts = F.transform(F.split(hit, "-"), lambda w: F.struct(kind.alias("kind"), F.lower(w).alias("norm"), w.alias("raw")))
    return F.when(kind == "name", F.transform(words, atom)).when(kind == "bare", parts).otherwise(one)


def formatted(kind: Column, raw: Column, norm: Column, new: Column) -> Column:
    """The replacement in the mention's own format."""
    between = F.split(F.when(kind.isin("ssn", "phone", "card"), raw), "[0-9]", -1)  # what stands around the digits
    number = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(between) - 1), chars(new), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    spaced = F.split(F.when(kind == "iban", raw), "[A-Z0-9]", -1)
    iban = F.array_join(F.zip_with(F.slice(spaced, 1, F.size(spaced) - 1), chars(new), lambda a, b: F.concat(a, b)), "")
    name = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(new)).when(F.lower(raw) == raw, new).otherwise(F.initcap(new))
    secret = F.concat(F.regexp_extract(raw, r"(?s)\A(.*?)[A-Za-z0-9_\-/+]+\z", 1), new)
    return F.when(kind.isin("ssn", "phone", "card"), number).when(kind == "iban", iban).when((kind == "ip6") & (F.upper(raw) == raw), F.upper(new)).when(kind.startswith("surname") | kind.startswith("given"), name).when(kind == "secret", secret).otherwise(new)


def surrogate_table(entities: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """(kind, norm, new) of all distinct entities; no two share a replacement and none is a real entity."""
    now = materialize(entities.select("kind", "norm", F.lit(0).alias("attempt"), surrogate(key, F.col("kind"), F.col("norm"), F.lit(0)).alias("new")), "surrogates")
    real = now.select("kind", F.col("norm").alias("new"), F.lit(True).alias("_real"))
    for drawn_before in range(rounds + 1):
        best = now.groupBy("kind", "new").agg(F.min(F.struct(F.col("attempt") * -1, "norm")).alias("_b"), F.count("*").alias("_n"))  # who drew longest keeps it
        seen = best.join(real, ["kind", "new"], "left").where("_n > 1 or _real")
        bad = materialize(now.join(seen, ["kind", "new"]).where("_real or norm <> _b.norm").select("kind", "norm"), "collisions")
        if not bad.limit(1).count():
            return now
        if drawn_before == rounds:
            return free_values(now, bad, key)
        again = now.join(bad.withColumn("_bad", F.lit(True)), ["kind", "norm"], "left").withColumn("attempt", F.when(F.col("_bad"), drawn_before + 1).otherwise(F.col("attempt")))
        drawn = F.when(F.col("_bad"), surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))).otherwise(F.col("new"))
        now = materialize(again.select("kind", "norm", "attempt", drawn.alias("new")), "surrogates")


def free_values(now: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """``now`` with the unsettled numbers given free values of their format, in the order of keyed hashes.

    A format (kind, length, fixed first digits) is listed in full, which only formats near full come to.
    """
    head = F.when(F.col("kind") == "ssn", "").when((F.length("norm") == 11) & F.col("norm").startswith("1"), "1").otherwise(F.substring("norm", 1, 1))
    left = materialize(bad.select("kind", "norm", head.alias("_head"), F.length("norm").alias("_size")), "unsettled")
    sizes = left.groupBy("kind", "_head", "_size").count().collect()
    error = ValueError("a format has too few values to keep its entities distinct")
    if any(r["kind"] not in ("ssn", "phone") for r in sizes):
        raise error
    settled = now.join(left, ["kind", "norm"], "left_anti")
    parts = [settled.select("kind", "norm", "attempt", "new")]
    order = lambda c: F.sha2(F.concat_ws("|", F.lit(key), F.lit("rank"), c), 256)
    for kind, first, size, count in sizes:
        width = size - len(first)
        values = now.sparkSession.range(10**width).select(F.concat(F.lit(first), F.lpad(F.col("id").cast("string"), width, "0")).alias("new"))
        if kind == "phone" and first == "1" and size == 11:
            values = values.where(F.substring("new", 2, 1) >= "2")
        used = now.where(F.col("kind") == kind).select(F.col("norm").alias("new")).unionByName(settled.where(F.col("kind") == kind).select("new"))
        free = values.join(used, "new", "left_anti").orderBy(order(F.col("new"))).limit(count)
        free = materialize(free.select("new", F.row_number().over(Window.orderBy(order(F.col("new")))).alias("_rank")), "free")
        if free.count() < count:
            raise error
        mine = left.where((F.col("kind") == kind) & (F.col("_head") == first) & (F.col("_size") == size))
        mine = mine.select("kind", "norm", F.row_number().over(Window.orderBy(order(F.col("norm")))).alias("_rank"))
        parts.append(mine.join(free, "_rank").select("kind", "norm", F.lit(-1).alias("attempt"), "new"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "surrogates")


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _pos, _sub, _hit, _of, kind, norm, raw): an entity of a mention each; kind null for words that are no names."""
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hits = by_names(F.col("_text"), lambda p: F.regexp_extract_all(F.col("_text"), F.lit(p), F.lit(0)))
    found = plain.where(may_hold(F.col("_text"))).select("_id", F.xxhash64("_text").alias("_hash"), F.explode(F.array(hits)).alias("_hits")).where(F.size("_hits") > 0)
    # one row per entity of a mention, so that the text is searched once here and once when it is put together
    each = found.select("_id", "_hash", F.posexplode("_hits").alias("_pos", "_hit")).withColumn("_kind", kind_of(F.col("_hit")))
    each = each.select("_id", "_hash", "_pos", "_hit", F.col("_kind"), F.posexplode(atoms(F.col("_hit"), F.col("_kind"))).alias("_sub", "_atom"))
    each = materialize(each.select("_id", "_hash", "_pos", "_sub", "_hit", F.col("_kind").alias("_of"), "_atom.*").distinct(), "mentions")
    # a word alone is the name that the text first gives it
    own = each.where("_of = 'name'").groupBy("_id", "_hash", "norm").agg(F.min(F.struct("_pos", "_sub", "kind"))["kind"].alias("_as"))
    own = own.select(F.col("_id").alias("_oid"), F.col("_hash").alias("_ohash"), F.col("norm").alias("_onorm"), "_as")
    bare = each.where("_of = 'bare'").withColumn("_plain", F.col("norm").isin(ORDINARY)).join(own, F.col("_id").eqNullSafe(F.col("_oid")) & (F.col("_hash") == F.col("_ohash")) & (F.col("norm") == F.col("_onorm")), "left")
    return each.where("_of <> 'bare'").unionByName(bare.withColumn("kind", F.when(~F.col("_plain"), F.col("_as"))).select(each.columns))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, count_col: str = "n_entities") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and the number of replaced mentions as ``count_col``."""
    each = materialize(mentions(docs, id_col, text_col), "entities")
    table = surrogate_table(each.where("kind is not null").select("kind", "norm").distinct(), key)
    new = each.join(table, ["kind", "norm"], "left").withColumn("_new", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(formatted(F.col("kind"), F.col("raw"), F.col("norm"), F.col("new"))))
    spoken = new.groupBy("_id", "_hash", "_pos", "_of", "_hit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_sub", "_new"))), lambda x: x["_new"]).alias("_list"), F.max(F.col("kind").isNotNull()).alias("_real"))
    before = F.when(F.col("_of") == "name", F.regexp_extract("_hit", rf"\A({TITLE})", 1)).otherwise("")
    marks = F.regexp_extract_all(F.substr("_hit", F.length(before) + 1), F.lit("[ -]"), F.lit(0))  # between the words of a name
    whole = F.array_join(F.zip_with("_list", F.slice(marks, 1, F.size("_list") - 1), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    spoken = spoken.withColumn("_new", F.concat(before, whole))
    lists = spoken.groupBy("_id", "_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_new"))), lambda x: x["_new"]).alias("_list"), F.count_if("_real").alias("_count"))
    lists = materialize(lists.where("_count > 0").withColumnsRenamed({"_id": "_lid", "_hash": "_lhash"}), "replacements")
    small = lists.count() <= broadcast_rows
    names = docs.columns
    work = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_lid")) & (F.xxhash64("_text") == F.col("_lhash"))
    joined = work.join(F.broadcast(lists) if small else lists, same, "left")
    pieces = by_names(F.col("_text"), lambda p: F.split("_text", p, -1))
    woven = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size("_list")), "_list", lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    text = F.when(F.col("_list").isNull(), F.col("_text")).otherwise(woven)
    return joined.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in names if c != count_col], F.coalesce("_count", F.lit(0)).cast("long").alias(count_col))

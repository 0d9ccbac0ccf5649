"""Surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by keyed surrogates of the same type and format. Most types are replaced by
a keyed permutation of their own value space, a Feistel network over decimal digits or address halves, so
distinct values stay distinct by construction, however many there are; equal values get equal surrogates
(coreference) in every document and run under the same key. Card numbers and IBANs keep whether their check digits are right.
Types whose surrogates are cut from a hash (e-mail addresses, names, secrets) go through a collision check over all
distinct values: those that collide, or meet a value that is itself in the data, get another attempt.
Names keep title, gender, script, case, and the number and initials of given names. A family name has one surrogate,
whatever stands before it, and is checked on its own; another attempt at a whole name only changes the given name.
E-mail addresses keep the shape of their local part, and one domain has one surrogate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import save

# What entities look like, in the order in which they are tried.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
AWS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
SECRET_HEAD = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s*(?:=|:(?=\s*[\"']?[^\s\"']*[0-9]))\s*[\"']?)"
SECRET = SECRET_HEAD + r"[^\s\"'<>]{5,}[^\s\"'<>.,;:!?)]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])(?:3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}|(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[ -]?[0-9]{1,3})?|[2-6][0-9]{12,18})(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
TITLES = {"m": r"Mr\.?|Herr|Monsieur|Señor|Sr\.|господин|г-н", "f": r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Sra\.|госпожа|г-жа"}
WORD = r"\p{Lu}(?:[\p{L}'’-]+|\.)"
NAME = rf"(?:\b(?:{TITLES['m']}|{TITLES['f']}) ){WORD}(?: {WORD}){{0,4}}"
TYPES = {"email": EMAIL, "key": AWS_KEY, "secret": SECRET, "iban": IBAN, "ip": IPV4, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
#: No entity begins inside a word; that also keeps the scan from trying each type at each letter.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in TYPES.values()) + ")"
#: A text without any of these has no entity.
HINT = rf"[0-9@]|[Pp][Aa][Ss][Ss]|[Pp][Ww][Dd]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii]|AKIA|ASIA|(?:{TITLES['m']}|{TITLES['f']}) "
#: Types whose surrogates are cut from a hash.
HASHED = ("email", "key", "secret", "family", "name")
#: Attempts up to this count are sent to every task as one map; more are joined to the rows that need them.
SMALL = 100_000

# Given names by script and gender, and parts of family names by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("latin", "f"): "Alma Berta Clara Diana Emma Flora Greta Hanna Ida Julia Klara Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Мария Ольга".split(),
}
PARTS = {"latin": "ba de fi go hu ka le mi no pu ra se ti vo wa ze".split(), "cyrillic": "ба де фи го ху ка ле ми но пу ра се ти во ва зе".split()}
#: Rounds of the check; each needs fewer attempts than the one before by the size of the hash's range.
ROUNDS = 6


def _hash(key: str, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(key), *cols)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _permuted(key: str, digits: Column) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 34): each half in turn is shifted by a hash of the other, modulo its own range."""

    def halves(d: Column) -> Column:
        a = F.floor(F.length(d) / 2).cast("int")
        start = F.struct(F.substring(d, F.lit(1), a).alias("l"), F.substring(d, a + 1, F.length(d)).alias("r"))
        out = F.aggregate(F.array(*map(F.lit, range(4))), start, lambda s, k: F.when(k % 2 == 0, F.struct(_shifted(s["l"], _hash(key, k, s["r"])).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], _hash(key, k, s["l"])).alias("r"))))
        return _let(out, lambda s: F.concat(s["l"], s["r"]))

    return _let(digits, halves)


def _shifted(digits: Column, by: Column) -> Column:
    n = F.length(digits)
    power = F.pow(F.lit(10.0), n).cast("long")
    return F.when(n > 0, F.lpad((F.pmod(digits.cast("long") + F.pmod(by, power), power)).cast("string"), n, "0")).otherwise("")


def _filled(shape: Column, digits: Column) -> Column:
    """shape with its digits, in turn, replaced by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def fill(d: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(d, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

        return F.aggregate(F.split(shape, ""), start, step)["out"]

    return _let(digits, fill)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows some digits."""
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when((F.length(digits) - i) % 2 == 1, F.floor(c.cast("int") * 2 / 10) + F.pmod(c.cast("int") * 2, F.lit(10))).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(doubled, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(10)), F.lit(10))


def _card(key: str, value: Column) -> Column:
    """All digits but the last permuted; the last keeps its distance from the right check digit, so valid numbers stay valid."""

    def card(d: Column) -> Column:
        n = F.length(d)
        old = F.substring(d, F.lit(1), n - 1)
        return _let(_permuted(f"{key}/card", old), lambda new: _filled(value, F.concat(new, F.pmod(_luhn(new) + F.substring(d, n, F.lit(1)).cast("int") - _luhn(old), F.lit(10)).cast("string"))))

    return _let(_digits(value), card)


def _valid_card(value: Column) -> Column:
    """Whether a number is that of a card: an issuer's first digit, and the right check digit."""
    d = _digits(value)
    return d.rlike("^[2-6]") & (_luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)).cast("int"))


def _mod97(text: Column) -> Column:
    """An IBAN's letters and digits as a number, A being 10, modulo 97."""

    def step(n: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: step(n, c).cast("int"))


def _check(country: Column, account: Column) -> Column:
    """The right check digits, as a number."""
    return F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))


def _valid_iban(value: Column) -> Column:
    """Whether the check digits are right; an account of digits only counts in any case."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.substring(bare, 3, 40).rlike("^[0-9]+$") | (_check(F.substring(bare, 1, 2), F.substring(bare, 5, 40)) == F.substring(bare, 3, 2).cast("int"))


def _iban(key: str, value: Column) -> Column:
    """The account's digits permuted, its letters moved by a hash of those; the check digits keep their distance from the right ones."""

    def iban(bare: Column) -> Column:
        country, old = F.substring(bare, 1, 2), F.substring(bare, 5, 40)

        def account(digits: Column) -> Column:
            letters = F.transform(F.split(old, ""), lambda c, i: F.when(c.between("0", "9"), c).otherwise(F.char(F.pmod(F.ascii(c) - 65 + F.pmod(_hash(f"{key}/iban", digits, i), F.lit(26)), F.lit(26)) + 65)))
            return _filled(F.array_join(letters, ""), digits)

        def whole(new: Column) -> Column:
            far = F.substring(bare, 3, 2).cast("int") - _check(country, old)
            check = F.pmod(_check(country, new) - 2 + far, F.lit(97)) + 2
            return _reshaped(value, F.concat(country, F.lpad(check.cast("string"), 2, "0"), new))

        return _let(_let(_permuted(f"{key}/iban", _digits(old)), account), whole)

    return _let(F.replace(value, F.lit(" "), F.lit("")), iban)


def _reshaped(shape: Column, text: Column) -> Column:
    """text with spaces where shape has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(text, s["at"], F.lit(1)))).alias("out"), (s["at"] + (c != " ").cast("int")).alias("at"))
    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _ip(key: str, value: Column) -> Column:
    part = F.split(value, r"\.")
    left, right = (part[i].cast("int") * 256 + part[i + 1].cast("int") for i in (0, 2))
    for k in range(4):
        if k % 2:
            right = F.pmod(right + F.pmod(_hash(f"{key}/ip{k}", left), F.lit(65536)), F.lit(65536))
        else:
            left = F.pmod(left + F.pmod(_hash(f"{key}/ip{k}", right), F.lit(65536)), F.lit(65536))
    return F.concat_ws(".", *(x.cast("int").cast("string") for side in (left, right) for x in (F.floor(side / 256), F.pmod(side, F.lit(256)))))


def _phone(key: str, value: Column) -> Column:
    """A country code stays, the other digits are permuted."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _filled(rest, _permuted(f"{key}/phone", _digits(rest))))


def _hex(key: str, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), attempt.cast("string"), value), 256)


def _email(key: str, value: Column, attempt: Column) -> Column:
    """Letters and digits of the local part by others, from the second attempt on with more digits; a domain of its own for each domain."""
    lower = F.lower(value)
    domain = F.substring_index(lower, "@", -1)
    host = F.lower(F.conv(F.substring(_hex(f"{key}/domain", domain, F.lit(0)), 1, 13), 16, 36))

    def local(h: Column) -> Column:
        byte = lambda i: F.conv(F.substring(h, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        chars = F.transform(F.split(F.substring_index(lower, "@", 1), ""), lambda c, i: F.when(c.between("0", "9"), (byte(i) % 10).cast("string")).when(c.between("a", "z"), F.char(byte(i) % 26 + 97)).otherwise(c))
        more = F.when(attempt > 0, F.right(F.lpad(F.conv(F.substring(h, 50, 12), 16, 10), 16, "0"), F.least(attempt * 4, F.lit(16)))).otherwise("")
        return F.concat(F.array_join(chars, ""), more)

    return F.concat(_let(_hex(f"{key}/email", lower, attempt), local), F.lit("@"), host, F.lit(".example.com"))


def _key(key: str, value: Column, attempt: Column) -> Column:
    h = _hex(f"{key}/key", value, attempt)
    tail = F.concat(*(F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "A") for i in (1, 11)))
    return F.concat(F.substring(value, 1, 4), F.upper(tail))


def _secret(key: str, value: Column, attempt: Column) -> Column:
    """What introduces the secret stays; the secret is as many digits of a hash, however long."""
    head = F.regexp_extract(value, f"^{SECRET_HEAD}", 0)
    body = F.substring(value, F.length(head) + 1, F.length(value))
    times = F.ceil(F.length(body) / 64).cast("int")
    return F.concat(head, F.substring(F.repeat(_hex(f"{key}/secret", body, attempt), times), F.lit(1), F.length(body)))


def _pick(items: list[str], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(h, F.lit(len(items))) + 1).cast("int"))


def _family(value: Column) -> Column:
    """The family name of a detected name, in lower case."""
    return F.lower(F.element_at(F.split(value, " "), -1))


def _script(family: Column, made: Callable[[str], Column]) -> Column:
    return F.when(family.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _surname(key: str, family: Column, attempt: Column) -> Column:
    """A family name (in lower case) from syllables, in the same script."""
    return _script(family, lambda s: F.initcap(F.concat(*(_pick(PARTS[s], _hash(f"{key}/name{i}", family, attempt)) for i in range(5)))))


def _given(key: str, value: Column, attempt: Column) -> Column:
    """Given names of the title's gender and in the script of a detected name, as many as it has; another attempt adds names with hyphens. Initials stay initials. '' if it has none."""
    part = F.split(value, " ")
    male, family = part[0].rlike(rf"^(?:{TITLES['m']})$"), F.element_at(part, -1)
    old = F.slice(part, F.lit(2), F.greatest(F.size(part) - 2, F.lit(0)))

    def made(s: str) -> Column:
        def one(name: Column, i: Column, k: Column) -> Column:
            h = _hash(f"{key}/given", F.lower(name), i, k, attempt)
            return F.when(male, _pick(GIVEN[s, "m"], h)).otherwise(_pick(GIVEN[s, "f"], h))

        def named(name: Column, i: Column) -> Column:
            first = one(name, i, F.lit(0))
            full = F.array_join(F.transform(F.sequence(F.lit(0), attempt.cast("int")), lambda k: one(name, i, k)), "-")
            return F.when(name.endswith("."), F.concat(F.substring(first, 1, 1), F.lit("."))).otherwise(full)

        return F.array_join(F.transform(old, named), " ")

    return _script(family, made)


def _name(key: str, value: Column, attempt: Column, again: Column) -> Column:
    """Title kept; given names by _given, the family name by _surname (again: its attempt), in the case of the original."""
    part = F.split(value, " ")
    family, given = F.element_at(part, -1), _given(key, value, attempt)
    out = F.concat(F.when(given != "", F.concat(given, F.lit(" "))).otherwise(""), _surname(key, F.lower(family), again))
    return F.concat(part[0], F.lit(" "), F.when((family == F.upper(family)) & ~family.endswith("."), F.upper(out)).otherwise(out))


def kind_of(value: Column) -> Column:
    """The type of a detected entity; none for numbers that only look like one."""
    kind = reduce(lambda c, t: c.when(value.rlike(f"^(?:{TYPES[t]})$"), t), list(TYPES)[1:], F.when(value.rlike(f"^(?:{EMAIL})$"), "email")).otherwise("phone")
    return _let(kind, lambda k: F.when(((k == "card") & ~_valid_card(value)) | ((k == "iban") & ~_valid_iban(value)), "none").otherwise(k))


def surrogate(key: str, kind: Column, value: Column, attempt: Column, again: Column) -> Column:
    """again: the attempt of a name's family name."""
    out = F.when(kind == "phone", _phone(key, value)).when(kind == "card", _card(key, value)).when(kind == "ip", _ip(key, value))
    out = out.when(kind == "ssn", _filled(value, _permuted(f"{key}/ssn", _digits(value)))).when(kind == "iban", _iban(key, value))
    for t, make in {"email": _email, "key": _key, "secret": _secret}.items():
        out = out.when(kind == t, make(key, value, attempt))
    return out.when(kind == "name", _name(key, value, attempt, again)).otherwise(value)


def _normal(kind: Column, value: Column) -> Column:
    """What equal entities have in common: e-mail addresses ignore case."""
    return F.when(kind == "email", F.lower(value)).otherwise(value)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the hashed values whose first surrogate is another's too, or is in the data.

    found: distinct (kind, value), and a row of kind family for each family name. In each round the values that share a
    surrogate, but the smallest of them, move to the next attempt. A name is told from others by its given name and own family name.
    """
    found = found.where(F.col("kind").isin(*HASHED)).withColumn("attempt", F.lit(0))
    real = found.select("kind", F.col("value").alias("made"))
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    part = F.split(value, " ")
    made = F.when(kind == "family", F.lower(_surname(key, value, attempt))).when(kind == "name", F.concat_ws("|", part[0], _given(key, value, attempt), F.element_at(part, -1)))
    made = made.otherwise(surrogate(key, kind, value, attempt, F.lit(0)))
    for _ in range(ROUNDS):
        tried = found.withColumn("made", made)
        tried = tried.join(real.withColumn("is_real", F.lit(1)).distinct(), ["kind", "made"], "left")
        place = F.row_number().over(W.partitionBy("kind", "made").orderBy("attempt", "value"))
        tried = save(tried.withColumn("again", (place > 1) | F.col("is_real").isNotNull()), "surrogates")
        if tried.where("again").isEmpty():
            break
        found = tried.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    else:
        raise ValueError("surrogates still collide; use another key")
    return tried.where("attempt > 0").select("kind", "value", "attempt")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and n_entities and entities (map of type to count) added; a row for each row of docs.

    key: a secret of the caller's; who has it can tell surrogates of guessed values. A null text stays null with no
    entities; an empty one stays empty. Equal values have equal surrogates in all rows. Columns of docs named
    n_entities or entities are replaced, others stay as they are, whatever they are called.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_entities", "entities")
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("held"), "text")
    values = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    kind = kind_of(F.col("value"))
    found = rows.select(F.explode(F.array_distinct(values)).alias("value")).distinct().select(kind.alias("kind"), _normal(kind, F.col("value")).alias("value"))
    both = F.explode(F.when(F.col("kind") == "name", F.array(F.struct("kind", "value"), F.struct(F.lit("family").alias("kind"), _family(F.col("value")).alias("value")))).otherwise(F.array(F.struct("kind", "value")))).alias("e")
    found = save(found.select(both).select("e.*").distinct(), "entities")
    tag = lambda kind, value: F.concat(kind, F.lit(":"), value)
    again = attempts(found, key).select(tag(F.col("kind"), F.col("value")).alias("tag"), "attempt")
    rows = rows.withColumn("found", F.coalesce(values, F.array().cast("array<string>"))).withColumn("gaps", F.when(F.size("found") > 0, F.split("text", ANY, -1)))
    tags = F.flatten(F.transform("found", lambda v: _let(kind_of(v), lambda k: F.array(tag(k, _normal(k, v)), tag(F.lit("family"), _family(v))))))
    entries = F.map_from_entries(F.collect_list(F.struct("tag", "attempt"))).alias("again")
    if again.limit(SMALL + 1).count() <= SMALL:
        rows = rows.join(F.broadcast(again.agg(entries)), how="left")  # one row
    else:  # beyond what is sent to every task, a text's attempts are joined to it
        rows = rows.withColumn("row", F.xxhash64("text"))
        each = rows.select("row", F.explode(F.array_distinct(tags)).alias("tag")).distinct()
        rows = rows.join(each.join(again, "tag").groupBy("row").agg(entries), "row", "left")

    def attempt(t: Column) -> Column:
        return F.coalesce(F.try_element_at("again", t), F.lit(0))

    def made(v: Column) -> Column:
        return _let(kind_of(v), lambda k: _let(_normal(k, v), lambda n: F.struct(k.alias("kind"), surrogate(key, k, n, attempt(tag(k, n)), attempt(tag(F.lit("family"), _family(n)))).alias("text"))))

    rows = rows.withColumn("made", F.transform("found", made))
    joined = F.concat(F.array_join(F.zip_with(F.slice("gaps", F.lit(1), F.size("found")), "made", lambda gap, m: F.concat(gap, m["text"])), ""), F.element_at("gaps", -1))
    kinds = F.filter(F.transform("made", lambda m: m["kind"]), lambda k: k != "none")
    rows = rows.select("held", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("new"), kinds.alias("kinds"))
    counts = F.map_from_entries(F.transform(F.array_distinct("kinds"), lambda k: F.struct(k, F.size(F.filter("kinds", lambda x: x == k)))))
    rows = rows.select("held", "new", F.size("kinds").cast("long").alias("n"), counts.alias("counts"))
    return rows.select(*(rows["new"].alias(c) if c == "text" else rows["held"][c].alias(c) for c in names), rows["n"].alias("n_entities"), rows["counts"].alias("entities"))

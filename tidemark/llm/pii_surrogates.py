r"""Personal data replaced by keyed surrogates.

Detected entities are brought to a normal form (digits of a phone number, an
address in lower case), so that all their spellings are one entity.  Each
distinct entity of the corpus gets a surrogate from a keyed digest: of the same
type and format (length, separators, letter case, country code, Luhn digit,
hexadecimal digits) and, for names, of the same gender and script.  Surrogates
are then checked over the whole corpus: none may serve two entities or be itself
an entity that occurs; those that fail draw again.  So distinct entities stay
distinct, and equal ones equal, in all documents.

Short formats have few values, and all may be in use.  So from the draw
:data:`WIDE_ROUND` on a surrogate may be longer than its original: digits are
added at its end, more with every draw, and only addresses, which have four
numbers whatever their length, get larger numbers.  A draw is never the last.

What is detected: :data:`PATTERNS`.  Card numbers need a Luhn sum, phone numbers
seven digits.  People are found by a title before their name; each word of a name
is an entity of its own, whatever the title, so ``Mr. John Smith``, ``Dr. Smith``
and, in the documents that have one of these, plain ``John`` and ``Smith`` keep one
surrogate each.  Names that no title introduces in their document aren't found.

DataFrame and SQL functions only.  The patterns are tried once on every document;
only documents with entities are shuffled.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, operator
from .skew import join_groups

_MALE = r"Mr|Herr|Herrn|Monsieur|Señor|господин|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Mademoiselle|Señora|Señorita|госпожа|г-жа"
_EITHER = r"Dr|Prof"
#: Contests, not people, follow this title.
_NO_PERSON = r"Miss (?:Universe|World|America|USA|Earth|International|Teen)(?!\p{L})"
_WORD = r"(?:\p{Lu}\p{L}+|\p{Lu}['’]\p{L}+)(?:['’](?![sS](?!\p{L}))\p{L}+|-\p{L}+)*"
_NAME = rf"{_WORD}(?: {_WORD}){{0,2}}"
#: Initials between title and name stay as they are.
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
_TITLED = rf"^\S+ {_INITIALS}"
_SECRET = r"(?i:password|passwd|secret|token|api[_\-]?key)\s?[=:]\s?[\"']?"

#: Types in the order in which they are tried, with their patterns (Java).
PATTERNS: dict[str, str] = {
    # A plain word after a colon and a blank is prose: there the value needs a digit.
    "SECRET": rf"(?<![\p{{L}}\p{{N}}]){_SECRET}(?:(?<=:\s)(?=[A-Za-z+/_\-]*[0-9])|(?<!:\s))[A-Za-z0-9+/_\-]{{6,}}",
    "ACCESS_KEY": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "EMAIL": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "PHONE": r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){1,4}(?!\d|[.\-]\d)|(?<![\d.\-])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])",
    "IP": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\d|\.\d)",
    "IPV6": r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "SSN": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "CARD": r"(?<![\d.])(?:\d{13,19}(?!\d)|\d{4}(?<gap>[ \-])(?:\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{6}\k<gap>\d{5})(?!\d|[.\-]\d))",
    "PERSON": rf"(?<![\p{{L}}\p{{N}}])(?!{_NO_PERSON})(?:{_MALE}|{_FEMALE}|{_EITHER})\.? {_INITIALS}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A further mention of a name of the same document.
MENTION = "MENTION"
#: No pattern matches without one of these signs or beginnings of a title or an
#: access key, which are far quicker to look for than the patterns.
SIGNS = "[0-9@=:]"
BEGINNINGS = ["Mr", "Herr", "Monsieur", "Señor", "господин", "г-н", "Ms", "Miss", "Frau", "Mad", "Mme", "Mlle", "госпожа", "г-жа", "Dr", "Prof", "AKIA", "ASIA"]

#: Syllables of made-up names by script; endings by script and gender.
_SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te",
    "CYRILLIC": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са со та те",
    "GREEK": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε",
}
_ENDINGS = {
    "LATIN": ("rin", "lia", "son"), "CYRILLIC": ("рин", "лия", "нин"), "GREEK": ("νος", "λια", "κης"),
}
#: What stays of a domain: its last label, and a name reserved for examples.
_DOMAIN_END = r"(?:(?:^|\.)example)?\.[^.]*$"
#: From this draw on, surrogates may be longer than their originals.
WIDE_ROUND = 6


def _type_of(raw: Column) -> Column:
    out = F.lit(MENTION)
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""

    def part(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), part), F.lit(0), lambda a, x: a + x)


def _is_entity(raw: Column, kind: Column) -> Column:
    """Long numbers may be anything, years say, so cards need a Luhn sum; a plus
    sign and a few digits may be a score."""
    digits = _digits(raw)
    return F.when(kind == "CARD", _luhn(digits) % 10 == 0).when(kind == "PHONE", F.length(digits) >= 7).otherwise(True)


def _name_words(raw: Column) -> Column:
    """Words of a titled name; of a mention, the word itself."""
    return F.split(F.regexp_replace(raw, _TITLED, ""), " ")


def _units(raw: Column, kind: Column) -> Column:
    """Entities of a match, as ``(type, norm, role)``; the words of a name are
    entities of their own, whose role says what the match tells of them: M or F, a
    given name after a title of that gender, S, a surname."""
    digits = _digits(raw)
    code = F.length(F.regexp_extract(raw, r"^\+(\d{1,3})(?=[ .\-(])", 1))
    value = F.regexp_replace(raw, f"^{_SECRET}", "")
    hexadecimal = value.rlike("^[0-9a-f]+$")
    title = F.regexp_replace(F.regexp_extract(raw, r"^(\S+) ", 1), r"\.$", "")
    gender = F.when(title.rlike(f"^(?:{_MALE})$"), "M").when(title.rlike(f"^(?:{_FEMALE})$"), "F").otherwise("")
    words = _name_words(raw)

    def word(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "CYRILLIC").when(w.rlike(r"\p{IsGreek}"), "GREEK").otherwise("LATIN")
        role = F.when(kind == MENTION, "").when(i == F.size(words) - 1, "S").otherwise(gender)
        return F.struct(F.concat(F.lit("NAME "), script).alias("type"), F.lower(w).alias("norm"), role.alias("role"))

    def one(kind_: Column | str, norm: Column) -> Column:
        return F.array(F.struct((F.lit(kind_) if isinstance(kind_, str) else kind_).alias("type"), norm.alias("norm"), F.lit("").alias("role")))

    return (
        F.when(kind.isin("PERSON", MENTION), F.transform(words, word))
        .when(kind == "EMAIL", one("EMAIL", F.lower(raw)))
        .when(kind == "PHONE", one(F.concat(F.lit("PHONE "), code.cast("string")), digits))
        .when(kind.isin("CARD", "SSN"), one(kind, digits))
        .when(kind == "IBAN", one("IBAN", F.replace(raw, F.lit(" "), F.lit(""))))
        .when(kind == "IPV6", one("IPV6", F.lower(raw)))
        .when(kind == "SECRET", one(F.when(hexadecimal, "SECRET HEX").otherwise("SECRET"), value))
        .otherwise(one(kind, raw))
    )


def _draws(key: str, *what: Column) -> Column:
    """192 hexadecimal digits from a keyed digest."""
    seed = F.concat_ws("\x1f", F.lit(key), *what)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(3)])


def _draw(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 64) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _pick(alphabet: str, x: Column) -> Column:
    return F.substr(F.lit(alphabet), x % len(alphabet) + 1, F.lit(1))


_LOWER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _like(text: Column, stream: Column, keep: Column, hexadecimal: Column) -> Column:
    """Signs drawn class by class; the first ``keep`` and all separators stay."""

    def sign(c: Column, i: Column) -> Column:
        x = _draw(stream, i)
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), F.when(i == keep, _pick("123456789", x)).otherwise(_pick(_DIGIT, x)))
            .when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", x))
            .when(c.rlike("[A-Z]"), _pick(_LOWER.upper(), x))
            .when(c.rlike("[a-z]"), _pick(_LOWER, x))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", x))
            .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", x))
            .when(c.rlike(r"\p{L}"), _pick(_LOWER, x))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), sign), "")


def _syllables(parts: list[str], stream: Column, count: Column) -> Column:
    options = F.array(*[F.lit(p) for p in parts])
    made = F.transform(F.sequence(F.lit(0), count), lambda i: F.element_at(options, _draw(stream, i) % len(parts) + 1))
    return F.array_join(made, "")


def _surrogate(k: int) -> Column:
    """The draw ``k`` from the columns ``type``, ``norm``, ``ending``, ``domain`` and
    the digests ``stream`` and ``domain_stream``."""
    kind, norm, domain, stream = F.col("type"), F.col("norm"), F.col("domain"), F.col("stream")
    shown = F.regexp_replace(domain, _DOMAIN_END, "")
    no, start = F.lit(False), F.lit(0)
    added = max(0, k - WIDE_ROUND + 2) if k >= WIDE_ROUND else 0
    longer = F.concat(F.lit(""), *[_draw(stream, F.lit(63 - j % 64)).cast("string") for j in range(added)])
    email = F.concat(
        _like(F.substring_index(norm, "@", 1), stream, start, no), longer, F.lit("@"),
        # One domain has one surrogate, whoever writes from it.
        _like(shown, F.col("domain_stream"), start, no), F.regexp_extract(domain, _DOMAIN_END, 0),
    )

    def number(c: Column, i: Column) -> Column:
        if k >= 2 * WIDE_ROUND:  # numbers that no address has, if all addresses are in use
            return (256 + _draw(stream, i) * 4096 + _draw(stream, i + 8) + F.lit(1 << 24) * (k - 2 * WIDE_ROUND)).cast("string")
        if k >= WIDE_ROUND:
            return (1 + _draw(stream, i) % 254).cast("string")
        return F.when(F.length(c) == 3, 100 + _draw(stream, i) % 156).when(F.length(c) == 2, 10 + _draw(stream, i) % 90).otherwise(1 + _draw(stream, i) % 9).cast("string")

    ip = F.array_join(F.transform(F.split(norm, r"\."), number), ".")
    body = _like(norm, stream, F.lit(1), no)
    stem = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), longer)
    luhn = F.concat(stem, ((10 - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10).cast("string"))
    phone = _like(norm, stream, F.coalesce(F.substring_index(kind, " ", -1).try_cast("int"), start), no)
    name = F.lit(None).cast("string")
    for script, syllables in _SYLLABLES.items():
        man, woman, family = _ENDINGS[script]
        # Longer names the more often an entity had to draw.
        made = _syllables(syllables.split(" "), stream, F.lit(2 + (k + 1) // 2))
        end = F.when(F.col("ending") == "M", man).when(F.col("ending") == "F", woman).when(F.col("ending") == "S", family).otherwise("")
        name = F.when(kind == f"NAME {script}", F.concat(made, end)).otherwise(name)
    return (
        F.when(kind == "EMAIL", email)
        .when(kind == "IP", ip)
        .when(kind == "CARD", luhn)
        .when(kind.startswith("PHONE"), F.concat(phone, longer))
        .when(kind == "ACCESS_KEY", F.concat(_like(norm, stream, F.lit(4), no), longer))
        .when(kind == "IBAN", F.concat(_like(norm, stream, F.lit(2), no), longer))
        .when(kind.startswith("NAME"), name)
        .otherwise(F.concat(_like(norm, stream, start, kind.isin("SECRET HEX", "IPV6")), longer))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(key, type, norm, n, value)`` from distinct ``(key, type, norm, n, ending)``.

    Within a family of types (all numbers, all names of a script, ...) values
    are distinct and no value is an entity itself.  Draws go on until that holds
    for all: every draw has more values to choose from than the one before.
    """
    family = F.substring_index("type", " ", 1)
    todo = materialize(entities.withColumn("family", F.when(family == "NAME", F.col("type")).otherwise(family)), "entities")
    real = todo.select("family", F.col("norm").alias("value"), F.lit(True).alias("taken"))
    done = None
    for k in itertools.count():
        drawn = todo.withColumn("domain", F.substring_index("norm", "@", -1))
        drawn = drawn.withColumn("stream", _draws(key, F.col("type"), F.col("norm"), F.lit(str(k)))).withColumn("domain_stream", _draws(key, F.lit("DOMAIN"), F.col("domain")))
        drawn = drawn.withColumn("value", _surrogate(k)).select(*todo.columns, "value")
        taken = real if done is None else real.unionByName(done.select("family", "value", F.lit(True).alias("taken")))
        order = Window.partitionBy("family", "value").orderBy("type", "norm")
        checked = drawn.join(taken.distinct(), ["family", "value"], "left").withColumn("nth", F.row_number().over(order))
        checked = materialize(checked, f"surrogates-{k}")
        good = F.col("taken").isNull() & (F.col("nth") == 1)
        own = checked.where(good).drop("taken", "nth")
        done = own if done is None else done.unionByName(own)
        todo = checked.where(~good).drop("taken", "nth", "value")
        if todo.isEmpty():
            break
    return done.drop("family", "ending")


def _render(raw: Column, kind: Column, values: Column) -> Column:
    """The surrogate in the spelling of the match."""
    first = F.element_at(values, 1)

    def refill(pattern: str) -> Column:
        kept = lambda text: F.length(F.regexp_replace(text, f"(?!{pattern}).", ""))
        signs = F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(pattern), F.substr(first, kept(F.substr(raw, F.lit(1), i)) + 1, F.lit(1))).otherwise(c))
        return F.concat(F.array_join(signs, ""), F.substr(first, kept(raw) + 1))  # what a longer surrogate has more

    named = F.concat(
        F.when(kind == "PERSON", F.regexp_extract(raw, _TITLED, 0)).otherwise(""),
        F.array_join(F.zip_with(_name_words(raw), values, lambda w, v: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(v)).otherwise(F.initcap(v))), " "),
    )
    return (
        F.when(kind.isin("PERSON", MENTION), named)
        .when(kind.isin("PHONE", "CARD", "SSN"), refill("[0-9]"))
        .when(kind == "IBAN", refill("[A-Z0-9]"))
        .when(kind == "SECRET", F.concat(F.regexp_extract(raw, f"^{_SECRET}", 0), first))
        .when(kind.isin("EMAIL", "IPV6"), F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(first)).otherwise(first))
        .otherwise(first)
    )


def _found(text: Column) -> Column:
    """All matches in ``text``; an empty array for most documents at little cost."""
    may = text.rlike(SIGNS)
    for beginning in BEGINNINGS:
        may = may | text.contains(beginning)
    return F.coalesce(F.when(may, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))), F.array().cast("array<string>"))


def _with_mentions(text: Column, raw: Column) -> tuple[Column, Column]:
    """(matches, pieces of text between them), mentions of the names among the
    matches included."""
    people = F.filter(raw, lambda r: r.rlike(f"^(?:{PATTERNS['PERSON']})$"))
    words = F.flatten(F.transform(people, _name_words))
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    pattern = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    some = F.size(people) > 0
    again = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    return F.when(some, again).otherwise(raw), F.when(some, F.split(text, pattern)).otherwise(F.split(text, ANY))


@operator
def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced; all rows and columns stay.

    ``count_col`` adds the number of replacements.  Null text stays null and
    text without entities is unchanged to the byte; repeated rows are replaced
    alike; an empty table gives no rows.  Columns may have any names.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]
    # Rows travel as one structure, so that no name of a column can clash.
    scanned = docs.select(F.struct(*quoted).alias("doc"), _found(docs[f"`{text_col}`"]).alias("raw"))
    scanned = materialize(scanned, "pii-scan")
    text = F.col("doc")[text_col]
    some = F.size("raw") > 0

    def rows(df: DataFrame, text: Column, n: Column) -> DataFrame:
        return df.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns], *([n.cast("int").alias(count_col)] if count_col else []))

    raw, between = _with_mentions(text, F.col("raw"))
    hits = scanned.where(some).select(F.monotonically_increasing_id().alias("row"), "doc", raw.alias("raw"), between.alias("between"))
    hits = materialize(hits, "pii-hits")
    matches = hits.select("row", F.posexplode("raw").alias("idx", "raw")).withColumn("kind", _type_of(F.col("raw")))
    matches = matches.where(_is_entity(F.col("raw"), F.col("kind")))
    units = matches.select("row", "idx", "raw", "kind", F.posexplode(_units(F.col("raw"), F.col("kind"))).alias("at", "unit"))
    units = units.select("row", "idx", "raw", "kind", "at", "unit.*").withColumn("key", F.concat_ws(" ", "type", "norm"))
    units = materialize(units, "pii-units")
    told = {r: F.max((F.col("role") == r).cast("int")) == 1 for r in "MFS"}
    ending = F.when(told["M"] & ~told["F"], "M").when(told["F"] & ~told["M"], "F").when(told["S"] & ~told["M"], "S").otherwise("")
    entities = units.groupBy("key", "type", "norm").agg(F.count("*").alias("n"), ending.alias("ending"))
    values = materialize(surrogates(entities, key).select("key", "n", "value"), "pii-surrogates")
    joined = join_groups(units.drop("type", "norm", "role"), values, "key", "n", units.count())
    whole = joined.groupBy("row", "idx", "raw", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    shown = whole.select("row", "idx", _render(F.col("raw"), F.col("kind"), F.transform("v", lambda x: x.value)).alias("shown"))
    by_row = shown.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("idx", "shown"))).alias("shown"))
    filled = F.array_join(
        F.transform("between", lambda piece, i: F.concat(piece, F.coalesce(F.try_element_at(F.col("shown"), i), F.get(F.col("raw"), i), F.lit("")))), ""
    )
    untouched = rows(scanned.where(~some), text, F.lit(0))
    return untouched.unionByName(rows(hits.join(by_row, "row", "left"), filled, F.coalesce(F.cardinality("shown"), F.lit(0))))

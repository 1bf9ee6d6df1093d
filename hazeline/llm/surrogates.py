"""Personal data replaced by surrogates, with DataFrame functions alone.

One pattern finds mail addresses, IBANs, card numbers, social security numbers, network addresses, phone numbers and titled names.
An entity's surrogate follows from a keyed hash of its type and normal form, so equal entities get equal surrogates in all documents,
and keeps its shape: digits for digits with the separators where they were, network octets in range, letters of the same script and
case, mail domains under ``example.com``, card numbers with a valid check digit; names are put together from syllables of the same
script, given names with an ending of the title's gender. With every attempt names get a syllable more, and from ``WIDER_FROM`` on phone
numbers a digit more.

A titled name is two entities, the given name (with its gender) and the surname, each with one surrogate in all documents: so "Frau Eva
Müller", "Frau Müller" and "Mrs. Müller" stay one person. In a document that names somebody with a title, the same given names and surnames
are replaced where they stand alone, too, as whole words; other capitalised words stay.

Distinct entities must keep distinct surrogates, and no surrogate may be another document's real entity: all distinct entities are
compared by (type, surrogate), and those that clash are numbered and hashed anew until none do. Only clashing entities carry a number;
they are joined to the documents that hold them, by the hash of the text.

Scale: one scan finds entities; what is shuffled is entities, and texts once for the join with the (few) numbered ones.

Cards have 13 to 19 digits and a valid check digit; sixteen digits in fours, also with up to three more behind them, count as a card
without one, as a mistyped card is personal, too. National phone numbers are those with a leading zero or in the American form with
separators; ten digits in a row without a zero are no phone number.

Edge cases: null text stays null with no entities; text without entities is unchanged; a repeated row gets the same result; an
entity inside a longer run of digits or letters is not one; a mail address has at most 64 characters before the @ and ten labels of at most
63 behind it, a name's part at most 41 letters: so each place of a text costs a bounded number of steps, however long its runs are; a word that is both a given name and a surname of one document is, alone, the given name; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import written

MOST_ATTEMPTS = 25
COPY_SALTS = 8
#: From this attempt on a phone number gets a digit more with each.
WIDER_FROM = 4
#: Types in the order in which the pattern tries them.
# Shapes of personal data, titles and names.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,10}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.])(?:\d{4}[ -]?){3}\d{4}(?:[ -]\d{1,3})?(?![\w])",
    "number": r"(?<![\w.+])[1-9](?:\d{12,18}|\d{3}[ -]\d{6}[ -]\d{4,5}|\d{3}[ -]\d{3}[ -]\d{3}[ -]\d{3})(?![\w]|[ -]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
             r"|(?<![\w.+/-])(?:1[ .-])?[2-9]\d{2}(?:-[2-9]\d{2}-|\.[2-9]\d{2}\.| [2-9]\d{2} )\d{4}(?![\w]|[.-]\d)"
             r"|(?<![\w.+/-])0[1-9](?:\d{8,9}|(?:[ .-]\d{2}){4}|\d{1,3}[ -]\d{3,4}[ -]\d{3,4}|\d{0,3}[ /-]\d{6,8})(?![\w]|[./-]\d)"
             r"|(?<![\w.+/-])00[1-9]\d{0,2}(?:[ .-]\d{2,8}){2,5}(?!\w)",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? "
            r"\p{Lu}\p{Ll}{1,40}+(?!\p{Ll})(?: \p{Lu}\p{Ll}{1,40}+(?!\p{Ll}))?",
}
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Señora"
TITLE = r"^(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? "
#: Endings of given names by script: female, male.
ENDINGS = {"Latin": ("na", "n"), "Cyrillic": ("на", "н"), "Greek": ("να", "ς")}
#: 64 syllables of each script, from 16 beginnings and 4 vowels; the first script's serve all others.
SYLLABLES = {script: [b + v for b in beginnings.split() for v in vowels.split()] for script, beginnings, vowels in (
    ("Latin", "b br d f g h k l m n p r s st t v", "a e i o"), ("Cyrillic", "б бр д ф г х к л м н п р с ст т в", "а е и о"),
    ("Greek", "β βρ δ φ γ χ κ λ μ ν π ρ σ στ τ ζ", "α ε ι ο"))}
#: Syllables of a surname and of a given name (before its ending) at the first attempt; as many more as the hash has digits for.
LEAST_SYLLABLES, LEAST_GIVEN, MOST_SYLLABLES = 3, 2, 30
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A capitalised word that isn't the beginning of a mail address; looked at only in texts that hold a titled name.
WORD = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}{1,40}+(?![\p{L}\p{N}_]|[A-Za-z0-9._%+-]{0,64}+@)"
ANY_OR_WORD = f"{ANY}|(?:{WORD})"
#: Parts of names as entities: ``f~`` or ``m~`` before a given name, ``~`` before a surname.
MARK = r"^[fm]?~"
#: Every pattern needs a digit, an @ or a title: most texts have none and are not searched further.
NEEDED = r"[0-9@]|\b(?:Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor)"


def kind_of(entity: Column) -> Column:
    """First type whose pattern the whole entity fits; a number is a card if its check digit is right, and else ``none``."""
    kind = F.when(F.substring(entity, 1, 1) == "~", F.lit("surname")).otherwise(F.lit("given"))
    for name, pattern in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        found = F.when(_checked(entity), F.lit("card")).otherwise(F.lit("none")) if name == "number" else F.lit(name)
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), found).otherwise(kind)
    return kind


def _checked(entity: Column) -> Column:
    return _let(F.regexp_replace(entity, r"\D", ""), lambda n: F.substring(n, -1, 1) == _check_digit(n.substr(F.lit(1), F.length(n) - 1)))


def is_entity(candidate: Column) -> Column:
    """All that the patterns find are entities, but numbers without a valid check digit."""
    number = candidate.rlike(f"^(?:{PATTERNS['number']})$") & ~candidate.rlike(f"^(?:{PATTERNS['card']})$")
    return ~F.when(number, ~_checked(candidate)).otherwise(F.lit(False))


def parts_of(candidate: Column) -> Column:
    """The entities of what the patterns found: the parts of a titled name, or the whole of anything else; none of a false number."""
    words = F.split(F.regexp_replace(candidate, TITLE, ""), " ")
    gender = F.when(candidate.rlike(f"^(?:{FEMALE_TITLES})[. ]"), "f~").otherwise("m~")
    surname = F.concat(F.lit("~"), F.element_at(words, -1))
    name = F.when(F.size(words) == 2, F.array(F.concat(gender, words[0]), surname)).otherwise(F.array(surname))
    return (F.when(candidate.rlike(f"^(?:{PATTERNS['name']})$"), name).when(is_entity(candidate), F.array(candidate))
            .otherwise(F.array().cast("array<string>")))


def normal_form(entity: Column, kind: Column) -> Column:
    """What makes two spellings the same entity: digits alone, small letters for mail."""
    digits = F.regexp_replace(entity, r"[^0-9A-Za-z]", "")
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("ip", "given", "surname"), entity).otherwise(digits)


def _number(hexes: Column, at: int | Column, below: int) -> Column:
    """A number below ``below`` from six hexadecimal digits of a hash."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substring(hexes, F.pmod(at * 6, F.lit(56)) + 1, F.lit(6)), 16, 10).cast("long") % below).cast("int")


def _stream(secret: str, text: Column) -> Column:
    """More hexadecimal digits than any entity has characters."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{secret}/{i}/"), text), 256) for i in range(2)])


def _reshaped(entity: Column, hexes: Column) -> Column:
    """Digits for digits, letters for letters of the same case, all else as it stands; separators don't count as places."""
    def char(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^0-9A-Za-z]", ""))
        number = F.conv(F.substring(hexes, F.pmod(before * 3, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), number % 26 + 1, F.lit(1))
        return (F.when(c.rlike("[0-9]"), (number % 10).cast("string")).when(c.rlike("[a-z]"), letter)
                .when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c))
    return F.array_join(F.transform(F.split(entity, ""), char), "")


def _check_digit(body: Column) -> Column:
    """Luhn digit behind the digits of ``body``."""
    doubled = F.transform(F.split(body, ""), lambda c, i: F.when(
        (F.length(body) - i) % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return ((F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def surrogate(entity: Column, attempt: Column, secret: str) -> Column:
    """The replacement of an entity; ``attempt`` above 0 gives others."""
    def with_kind(kind: Column) -> Column:
        seed = F.concat_ws("/", kind, normal_form(entity, kind), attempt.cast("string"))
        return _let(_stream(secret, seed), lambda hexes: _let(
            _reshaped(entity, hexes), lambda reshaped: _by_kind(entity, kind, attempt, hexes, reshaped)))
    return _let(kind_of(entity), with_kind)


def _name(entity: Column, kind: Column, attempt: Column, hexes: Column) -> Column:
    """A part of a name: syllables in the script of the entity, one more with every attempt, behind the entity's mark."""
    given = kind == "given"
    n = F.least(F.when(given, F.lit(LEAST_GIVEN)).otherwise(F.lit(LEAST_SYLLABLES)) + attempt, F.lit(MOST_SYLLABLES))

    def of(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        female, male = ENDINGS[script]
        ending = F.when(~given, "").when(F.substring(entity, 1, 1) == "f", female).otherwise(male)
        return F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(
            syllables, (F.conv(F.substring(hexes, F.lit(17) + i * 3, F.lit(3)), 16, 10).cast("int") % len(SYLLABLES[script])) + 1)), ""), ending))
    made = of("Latin")
    for script in list(SYLLABLES)[1:]:
        made = F.when(entity.rlike(rf"{MARK}\p{{Is{script}}}"), of(script)).otherwise(made)
    return F.concat(F.regexp_extract(entity, MARK, 0), made)


def _by_kind(entity: Column, kind: Column, attempt: Column, hexes: Column, reshaped: Column) -> Column:
    # Short local parts have few shapes, so the domain carries 48 bits of the hash.
    mail = F.concat(_reshaped(F.substring_index(entity, "@", 1), hexes), F.lit("@mail"), F.substring(hexes, 65, 12), F.lit(".example.com"))
    # The first digit, which names the network, stays; the last one is the check digit.
    digits = F.regexp_replace(reshaped, r"\D", "")
    body = F.concat(F.substring(F.regexp_replace(entity, r"\D", ""), 1, 1), digits.substr(F.lit(2), F.length(digits) - 2))
    number = _let(body, lambda b: F.concat(b, _check_digit(b)))
    card = _let(number, lambda own: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(
        own, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"\D", "")) + 1, F.lit(1))).otherwise(c)), ""))
    ip = F.concat_ws(".", (_number(hexes, 1, 223) + 1).cast("string"), *[_number(hexes, i, 256).cast("string") for i in (2, 3)],
                     (_number(hexes, 4, 254) + 1).cast("string"))
    # The first digit stays: the world zone or the leading zero. It is the same in all spellings of a number.
    start = F.regexp_extract(entity, r"^\D*\d", 0)
    phone = F.concat(start, F.substring(reshaped, F.length(start) + 1, F.length(entity)),
                     F.rpad(F.lit(""), F.greatest(attempt - (WIDER_FROM - 1), F.lit(0)), F.conv(F.substring(hexes, 100, 12), 16, 10)))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(reshaped, F.lit(3), F.length(entity)))
    return (F.when(kind == "none", entity).when(kind == "email", mail).when(kind == "card", card).when(kind == "ip", ip)
            .when(kind == "phone", phone).when(kind.isin("given", "surname"), _name(entity, kind, attempt, hexes)).when(kind == "iban", iban).otherwise(reshaped))


def numbered(entities: DataFrame, secret: str) -> DataFrame:
    """``entity``, ``attempt``: distinct entities that clash at attempt 0, with the first attempt free of clashes.

    Spellings of one normal form are one entity. Every round compares all surrogates in their present state with each other and with
    all real entities; of those that meet, the smallest keeps its surrogate, unless that is a real entity.
    """
    def key(value: Column, kind: Column) -> Column:
        return F.concat_ws("/", kind, normal_form(value, kind))

    distinct = entities.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    known = written(distinct.withColumn("normal", key(F.col("entity"), F.col("kind"))).groupBy("normal", "kind")
                    .agg(F.min("entity").alias("entity"), F.collect_set("entity").alias("spellings"))
                    .withColumn("attempt", F.lit(0)), "entities")
    for _ in range(MOST_ATTEMPTS):
        made = known.withColumn("made", key(surrogate(F.col("entity"), F.col("attempt"), secret), F.col("kind")))
        first = made.groupBy("made").agg(F.min("normal").alias("keeps"), F.count("*").alias("n"))
        real = known.select(F.col("normal").alias("made"), F.lit(True).alias("real"))
        clash = first.join(real, "made", "left").where("n > 1 OR real").select(
            "made", F.when(F.col("real").isNull(), F.col("keeps")).alias("keeps"))
        again = made.join(clash.withColumn("clash", F.lit(True)), "made", "left").withColumn(
            "again", F.col("clash").isNotNull() & ~F.coalesce(F.col("keeps") == F.col("normal"), F.lit(False)))
        again = written(again.select("normal", "kind", "entity", "spellings",
                                     (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"), "entities")
        known = again.drop("again")
        if again.where("again").isEmpty():
            return known.where("attempt > 0").select(F.explode("spellings").alias("entity"), "attempt")
    raise RuntimeError(f"surrogates still clash after {MOST_ATTEMPTS} attempts: a type has too few of them")


def replace_personal_data(docs: DataFrame, secret: str) -> DataFrame:
    """``doc_id``, number of entities, number of distinct ones, and the text with surrogates in place of them.

    The two parts of a titled name count as two entities.
    """
    none = F.array().cast("array<string>")
    found = docs.select("doc_id", "text", F.coalesce(
        F.when(F.col("text").rlike(NEEDED), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), none).alias("candidates"))
    # Parts of the text's titled names; where there are some, capitalised words are candidates as well.
    found = found.withColumn("names", F.array_sort(F.array_distinct(F.filter(
        F.flatten(F.transform("candidates", parts_of)), lambda p: p.rlike(MARK)))))
    named = F.size("names") > 0
    found = found.withColumn("candidates", F.when(named, F.regexp_extract_all("text", F.lit(ANY_OR_WORD), F.lit(0))).otherwise(F.col("candidates")))

    def entities_of(candidate: Column) -> Column:
        alone = F.slice(F.filter("names", lambda p: F.regexp_replace(p, MARK, "") == candidate), 1, 1)
        return F.when(candidate.rlike(f"^(?:{WORD})$"), alone).otherwise(parts_of(candidate))

    # All candidates keep their place between the gaps; those without entities stand for themselves.
    found = found.withColumn("places", F.transform("candidates", lambda c: F.struct(c.alias("raw"), entities_of(c).alias("parts"))))
    found = found.withColumns({"entities": F.flatten("places.parts"), "named": named}).drop("candidates", "names")
    # Texts without entities need no look-up and are dealt by their doc_id; copies of a text with some go to ``COPY_SALTS`` places.
    some = F.size("entities") > 0
    found = found.withColumns({"text_key": F.when(some, F.xxhash64("text")).otherwise(F.xxhash64("doc_id")),
                               "salt": F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS))})
    # The clashing ones by text: entities are few beside their texts.
    held = found.where(some).select("text_key", F.explode(F.array_distinct("entities")).alias("entity"))
    held = written(held, "held-entities")
    again = held.join(numbered(held, secret), "entity").distinct()
    by_text = again.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts"))
    # Written, so that its size is known before texts are shuffled for it: they are not where it is small.
    by_text = written(by_text, "attempts").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))))
    joined = found.join(by_text, ["text_key", "salt"], "left")
    gaps = F.when(F.col("named"), F.split("text", ANY_OR_WORD, -1)).otherwise(F.split("text", ANY, -1))

    def replaced(place: Column) -> Column:
        made = F.transform(place.parts, lambda p: F.regexp_replace(
            surrogate(p, F.coalesce(F.try_element_at("attempts", p), F.lit(0)), secret), MARK, ""))
        return F.when(F.size(place.parts) == 0, place.raw).otherwise(
            F.concat(F.regexp_extract(place.raw, TITLE, 0), F.array_join(made, " ")))

    rebuilt = _let(F.transform("places", replaced), lambda m: F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(m, i), F.lit("")))), ""))
    return joined.select(
        "doc_id", F.size("entities").alias("n_entities"), F.size(F.array_distinct("entities")).alias("n_distinct"),
        F.when(F.size("entities") == 0, F.col("text")).otherwise(rebuilt).alias("text"))

"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

Detected are e-mail addresses, phone, card, social-security and IBAN numbers, IPv4 addresses, values assigned to a token, key, secret or
password, and personal names behind a title, a known given name or words that introduce one. A second step finds every other mention of a document's names, alone or in
capitals. Equal entities get equal surrogates in all documents (coreference), unequal ones unequal surrogates (distinctness), and none gets the value of
another real entity; given names alone are permuted, so their surrogates are others' given names.

A surrogate is drawn from a keyed SHA-512 stream of (key, type, canonical form, attempt) and keeps type and format: digits stay digits and
letters letters, case, separators and length stay; a card number passes the Luhn test exactly if the original does; an IBAN keeps its country and has
right check digits; e-mail addresses move to the reserved TLD `.example`, those of one domain to one domain; a given name becomes one of the same gender and
script; a surname is built from syllables of its script, with the gendered ending where the script has one. Mentions of one number in two
formats share their digits and keep each its own format.

Candidates that collide are drawn again with the next attempt until every entity has a surrogate of its own; mailboxes, domains and surnames grow by a letter or
syllable with every fourth attempt, so short ones never run out. The entity table is distributed and never collected.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

KEY = "attesta-demonstration-key"

#: Given names by script and gender, and syllables for surnames.
GIVEN = {
    ("latin", "m"): "James John Robert Michael David William Thomas Peter Paul Mark George Hans Klaus Jürgen Wolfgang Pierre Jacques Michel André Carlos Juan José Pedro Luis".split(),
    ("latin", "f"): "Mary Anna Maria Susan Linda Sarah Laura Emma Julia Karen Alice Ursula Monika Sabine Heike Claire Sophie Camille Amélie Carmen Lucía Pilar Elena Rosa".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Άννα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mi na ne no pa ra re ro sa se ta te va vo".split(),
    "cyrillic": "ба ве во га да де до за ка ко ла ле ло ма ме на не но па ра ре ро са се та те".split(),
    "greek": "βα γα δε δο ζα θε κα κο λα λε μα μο να νε πα ρα ρε σα σε τα το φα".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Monsieur Madame Mme Señor Señora Господин Госпожа Κύριος Κυρία".split()

_NAMES = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_TITLES = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<=[:=\s\"'])(?=[A-Za-z0-9_+/=-]{8})(?<=(?i:token|secret|api[_-]?key|password|passwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9_+/=-]{8,}"
#: National numbers with spaces or none between their parts.
NATIONAL = r"(?:[2-9]\d{2} \d{3} \d{4}|[2-9]\d{9}|0[1-9]\d{1,3}[ /]\d{3,4} ?\d{3,5}|0[1-9]\d{8,9}|0[1-9](?: \d{2}){4})"
PHONE = rf"(?<![\w+])(?:\+?\d{{1,3}}[ .-]?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|(?:\d{{1,3}}[.-])?\d{{3}}[-.]\d{{3}}[-.]\d{{4}}|(?<!\d[.,]){NATIONAL}(?![.,]\d))(?![\w-])"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
PERSON = rf"(?<!\p{{L}})(?:{_NAMES})(?= \p{{Lu}}\p{{Ll}})"
_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))+"
#: Java's look-behind repeats no groups: up to five words between a title and the word in question.
_BETWEEN = "|".join(r"\p{Lu}[\p{L}'’-]{1,20} " * n for n in range(1, 6))
#: Words that introduce a name of two words or more.
INTRODUCTIONS = ["name is", "name's", "name:", "named", "signed", "signed,", "regards,", "sincerely,", "author:", "attn:", "heiße", "heißt", "Name ist", "m'appelle", "s'appelle", "nom:", "me llamo", "se llama", "nombre:"]
_INTRO = "|".join(sorted(INTRODUCTIONS, key=lambda t: (-len(t), t)))
_FEW = "|".join(r"\p{Lu}[\p{L}'’-]{1,20} " * n for n in range(1, 3))
INTRODUCED = rf"(?=\p{{Lu}})(?<=[\p{{L}},:] )(?:(?<=(?<!\p{{L}})(?i:{_INTRO}) )(?={_WORD} \p{{Lu}}\p{{Ll}})|(?<=(?<!\p{{L}})(?i:{_INTRO}) (?:{_FEW}))){_WORD}"
SURNAME = rf"(?=\p{{Lu}})(?<=[\p{{L}}.] )(?:(?<=(?<!\p{{L}})(?:{_TITLES}|{_NAMES})\.? )|(?<=(?<!\p{{L}})(?:{_TITLES})\.? (?:{_BETWEEN}))){_WORD}"
#: Look-arounds that fail at once for nearly every place stand before those that try many lengths.
ANY = f"(?:(?=[\\d+(])(?:{PHONE}|{SSN}|{CARD}|{IP})|{EMAIL}|{SECRET}|(?=\\p{{Lu}})(?:{IBAN}|{PERSON}|{SURNAME}|{INTRODUCED}))"


def mentions(text: Column) -> Column:
    """The mentions of personal data in a text, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def mentions_with_lone_names(text: Column, found: Column) -> tuple[Column, Column]:
    """The mentions, with those of the names among them (found) wherever they stand in the text, and the pattern that finds them."""
    names = F.filter(found, lambda m: kind(m).isin("given", "surname") & ~m.rlike(r"[^\p{L}'’-]"))
    every = F.array_distinct(F.concat(names, F.transform(names, F.upper)))
    longest = F.array_join(F.transform(F.reverse(F.array_sort(F.transform(every, lambda m: F.struct(F.length(m).alias("n"), m.alias("m"))))), lambda x: x["m"]), "|")
    pattern = F.when(F.size(every) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), longest, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ANY))
    return F.regexp_extract_all(text, pattern, F.lit(0)), pattern


def kind(mention: Column) -> Column:
    """The type of a mention; the bare mention has lost its context, so what fits no format is a secret."""
    fits = lambda p: mention.rlike(rf"^(?:{p})$")
    return (
        F.when(fits(EMAIL), "email").when(fits(SSN), "ssn").when(fits(PHONE), "phone").when(fits(CARD), "card").when(fits(IP), "ip").when(fits(IBAN), "iban")
        .when(fits(_NAMES) | fits(_NAMES.upper()), "given").when(fits(r"\p{Lu}\p{L}*['’-]?[\p{L}'’-]*") & ~mention.rlike("^[A-Z0-9_+/=-]{16,}$"), "surname").otherwise("secret")
    )


def canonical(type_: Column, mention: Column) -> Column:
    """The form by which mentions corefer: digits of numbers, lower-case addresses and names, IBANs without spaces."""
    given = F.create_map(*(F.lit(x) for names in GIVEN.values() for n in names for x in (n.upper(), n)))
    return (
        F.when(type_ == "given", F.coalesce(given[F.upper(mention)], mention)).when(type_.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", "")).when(type_.isin("email", "surname"), F.lower(mention))
        .when(type_ == "iban", F.replace(mention, F.lit(" "))).otherwise(mention)
    )


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _byte(stream: Column, i: Column) -> Column:
    """Byte i of a 64-byte stream of hex digits, going round."""
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _redrawn(text: Column, stream: Column, shift: int = 0) -> Column:
    """Letters and digits drawn again from the stream, each within its class; hex strings stay hex; all else stays."""
    hexed = text.rlike("^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")

    def each(c: Column, i: Column) -> Column:
        b = _byte(stream, i + shift)
        return (
            F.when(hexed & ~text.rlike("[A-F]"), _pick("0123456789abcdef", b)).when(hexed, _pick("0123456789ABCDEF", b)).when(c.rlike(r"\d"), _pick("0123456789", b))
            .when(c.rlike(r"\p{Ll}"), _pick("abcdefghijklmnopqrstuvwxyz", b)).when(c.rlike(r"\p{L}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), each), "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is at an even distance (0) from the end."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(text: Column, stream: Column) -> Column:
    n = F.length(text)
    body = F.concat(F.substring(text, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), n - 2), lambda i: _pick("0123456789", _byte(stream, i))), ""))
    right = F.pmod(-_luhn(_digits(F.concat(body, F.lit("0")))), F.lit(10))
    valid = _luhn(_digits(text)) % 10 == 0
    return F.concat(body, F.when(valid, right).otherwise((right + 1 + _byte(stream, F.lit(63)) % 9) % 10).cast("string"))


def _iban(text: Column, stream: Column) -> Column:
    country, body = F.substring(text, 1, 2), _redrawn(F.substring(text, F.lit(5), F.length(text)), stream)
    value = F.transform(_chars(F.concat(body, country, F.lit("00"))), lambda c: F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _surname(text: Column, stream: Column, attempt: Column) -> Column:
    def built(script: str) -> Column:
        letters = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + F.floor(attempt / 4).cast("int")), lambda i: F.element_at(letters, (F.pmod(_byte(stream, i), F.lit(len(SYLLABLES[script]))) + 1).cast("int"))), "")

    return (
        F.when(text.rlike(r"\p{IsCyrillic}"), F.concat(built("cyrillic"), F.when(text.rlike("[ая]$"), F.lit("ва")).otherwise(F.lit("в"))))
        .when(text.rlike(r"\p{IsGreek}"), F.concat(built("greek"), F.when(text.rlike("[ς]$"), F.lit("ς")).otherwise(F.lit("")))).otherwise(built("latin"))
    )


def _given_table(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its gender and script in a keyed order, so no two share one and none keeps its own."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\1{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def candidate(key: str, type_: Column, text: Column, attempt: Column) -> Column:
    """The surrogate that one attempt draws for the canonical form of an entity."""
    stream = F.sha2(F.concat_ws("\1", F.lit(key), type_, text, attempt.cast("string")), 512)
    given = F.create_map(*(F.lit(x) for pair in _given_table(key).items() for x in pair))
    longer = lambda name: F.concat(name, F.repeat(F.lit("a"), F.floor(attempt / 4).cast("int")))
    octets = [(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    return (
        F.when(type_ == "email", F.concat(_redrawn(longer(F.substring_index(text, "@", 1)), stream), F.lit("@"), F.substring_index(text, "@", -1)))
        .when(type_ == "domain", F.concat(_redrawn(longer(F.regexp_replace(text, r"\.[^.]*$", "")), stream), F.lit(".example")))
        .when(type_ == "card", _card(text, stream)).when(type_ == "iban", _iban(text, stream)).when(type_ == "ip", F.concat_ws(".", *octets))
        .when(type_ == "phone", F.concat(F.substring(text, 1, 1), F.substring(_redrawn(text, stream), F.lit(2), F.length(text))))
        .when(type_ == "given", given[text]).when(type_ == "surname", _surname(text, stream, attempt)).otherwise(_redrawn(text, stream))
    )


def surrogate_table(entities: DataFrame, key: str, max_attempts: int = 40) -> DataFrame:
    """(type, canonical, surrogate) for distinct entities (type, canonical): no two of a type share a surrogate, none is another's original.

    Given names come from a permutation and need no check.
    """
    drawn = entities.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    spent: list[DataFrame] = []
    for _ in range(max_attempts):
        tried = materialize(drawn.withColumn("surrogate", candidate(key, F.col("type"), F.col("canonical"), F.col("attempt"))), "tried")
        taken = entities.select("type", F.col("canonical").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("type", "surrogate"))
        first = tried.groupBy("type", "surrogate").agg(F.min("canonical").alias("owner")).join(taken, ["type", "surrogate"], "left_anti")
        given = F.col("type") == "given"
        first = materialize(first, "owners")
        judged = tried.join(first, ["type", "surrogate"], "left").withColumn("ok", given | (F.coalesce(F.col("owner"), F.lit("")) == F.col("canonical")))
        judged = materialize(judged, "judged")
        good = judged.where("ok").select("type", "canonical", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        drawn = judged.where("not ok").select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
        discard(tried, first)
        spent.append(judged)
        if drawn.isEmpty():
            done = materialize(settled, "drawn")
            discard(*spent)
            return done
    raise RuntimeError("the space of surrogates is too small for the entities of a type")


def with_domains(entities: DataFrame) -> DataFrame:
    """The entities and the domains of the addresses among them, as entities of their own."""
    domains = entities.where("type = 'email'").select(F.lit("domain").alias("type"), F.substring_index("canonical", "@", -1).alias("canonical"))
    return entities.unionByName(domains.distinct())


def moved(table: DataFrame) -> DataFrame:
    """The surrogates with every address moved to its domain's surrogate; distinct addresses of one domain and distinct domains stay distinct."""
    domains = table.where("type = 'domain'").select(F.col("canonical").alias("_domain"), F.col("surrogate").alias("_moved"))
    mails = table.where("type = 'email'").withColumn("_domain", F.substring_index("canonical", "@", -1)).join(domains, "_domain")
    mails = mails.select("type", "canonical", F.concat(F.substring_index("surrogate", "@", 1), F.lit("@"), "_moved").alias("surrogate"))
    return table.where("type not in ('email', 'domain')").unionByName(mails)


def rendered(type_: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    chars, digits = _chars(mention), _chars(surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def refill(test: str) -> Column:
        step = lambda a, c: F.when(c.rlike(test), F.struct(F.concat(a["out"], F.get(digits, a["k"])).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
        return F.aggregate(chars, start, step)["out"]

    by_letter = F.array_join(F.zip_with(chars, digits, lambda m, s: F.when(F.coalesce(m.rlike(r"\p{Lu}"), F.lit(False)), F.upper(s)).otherwise(s)), "")
    cased = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return (
        F.when(type_.isin("phone", "card", "ssn"), refill(r"\d")).when(type_ == "iban", refill("[A-Z0-9]")).when(type_ == "surname", cased)
        .when(type_.isin("email", "given") & (mention == F.upper(mention)), F.upper(surrogate)).when(type_ == "email", by_letter).otherwise(surrogate)
    )


def pseudonymize(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """Replaces the text and adds n_entities (long); all other columns and rows stay, repeated ones too.

    Texts without personal data stay as they are, null stays null with 0 entities. Columns named n_entities or starting with `_pii_` are replaced.
    Only documents with mentions are shuffled; their mentions are bounded by their own length.
    """
    docs = docs.drop("n_entities", *(c for c in docs.columns if c.startswith("_pii_")))
    found = docs.withColumn("_pii_m", mentions(F.col(text_col)))
    has = F.coalesce(F.size("_pii_m") > 0, F.lit(False))
    clean = docs.where(F.coalesce(F.size(mentions(F.col(text_col))) <= 0, F.lit(True))).withColumn("n_entities", F.lit(0).cast("bigint"))
    every, pattern = mentions_with_lone_names(F.col(text_col), F.col("_pii_m"))
    hits = found.where(has).withColumns({"_pii_row": F.monotonically_increasing_id(), "_pii_re": pattern, "_pii_m": every})
    hits = materialize(hits, "hits")
    parts = hits.select("_pii_row", F.posexplode("_pii_m").alias("pos", "mention")).withColumn("type", kind(F.col("mention")))
    parts = materialize(parts.withColumn("canonical", canonical(F.col("type"), F.col("mention"))), "mentions")
    entities = materialize(parts.select("type", "canonical").distinct(), "entities")
    named = materialize(with_domains(entities), "entities")
    drawn = surrogate_table(named, key)
    table = materialize(moved(drawn), "surrogates")
    new = parts.join(table, ["type", "canonical"]).select("_pii_row", F.struct("pos", rendered(F.col("type"), F.col("mention"), F.col("surrogate")).alias("new")).alias("part"))
    lists = materialize(new.groupBy("_pii_row").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["new"]).alias("_pii_new")), "lists")
    discard(parts, entities, named, drawn, table)
    gaps = F.split(F.col(text_col), F.col("_pii_re"), -1)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_pii_new"), i), F.lit("")))), "")
    changed = hits.join(lists, "_pii_row").withColumn(text_col, text).withColumn("n_entities", F.size("_pii_new").cast("bigint"))
    return clean.unionByName(changed.select(*clean.columns))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "n_entities", "text")

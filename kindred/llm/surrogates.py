"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Mentions are found by one pattern and, for cards and accounts, their check digits; names that stand after a title somewhere are looked for without one
throughout the corpus.  A mention is put in a canonical form for its type (so that an address in capitals or a
number with other separators is the same entity) and replaced by a surrogate drawn from a keyed hash of type, canonical form and attempt.
A surrogate keeps type, length, script, gender, check digits and the mention's own separators and case.  The table of distinct entities is checked:
where two entities meet in one surrogate, or a surrogate is itself an entity of the corpus, the later one draws
again, until none does; names get longer with each attempt, everything else from the sixth on, so that no form runs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

# Titles that go before a name, by the gender they tell.
MALE = "Mr Herr Hr Monsieur Señor Sr Signor Sig Sir Господин Г-н г-н Κύριος Κος".split()
FEMALE = "Mrs Ms Miss Frau Fr Madame Mme Mlle Señora Sra Señorita Srta Signora Госпожа Г-жа г-жа Κυρία Κα".split()
NEUTRAL = "Dr Prof Professor Professeur Doktor Docteur Doctor Доктор".split()
MALE_TITLES, FEMALE_TITLES, NEUTRAL_TITLES = ("|".join(dict.fromkeys([*words, *(w.upper() for w in words)])) for words in (MALE, FEMALE, NEUTRAL))
TITLES = f"{FEMALE_TITLES}|{MALE_TITLES}|{NEUTRAL_TITLES}"
NAME = r"[\p{Lu}\p{Lo}][\p{L}'\-]*\p{L}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# One pattern a type, tried in this order at each place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "secret": r"(?<=(?i:token|secret|passwd|password|api_key|apikey|api-key|access_key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?=[_\-]*[A-Za-z0-9])[A-Za-z0-9_\-]{12,}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.\-])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\w])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?![\w])",
    "name": rf"(?<![\p{{L}}])(?:{TITLES})\.?(?: (?:{TITLES})\.?){{0,2}} {NAME}(?: {NAME})?",
}
# A backreference counts groups, and the types are alternatives of one pattern; only "card" has a group.
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
RUN = rf"(?<![\p{{L}}]){NAME}(?: {NAME})+"  # where a name may stand without a title
FIRST_LETTERS = "".join(sorted({w[0] for w in TITLES.split("|")}))
TITLED = rf"(?=[{FIRST_LETTERS}])(?<!\p{{L}})(?:{TITLES})\.? [\p{{Lu}}\p{{Lo}}]"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
# Letters of a script, first and last.
SCRIPTS = ("az", "AZ", "ßÿ", "Āſ", "άώ", "аџ", "աֆ", "את", "ءي", "अह", "กฮ", "აჰ", "ぁゖ", "ァヺ", "一鿿", "가힣")
GREEK_ACCENTS = "άέήίϊόύϋώς"
BYTES = 128
LONGER = 5  # attempts after which a surrogate gets longer


def may_hold(text: Column) -> Column:
    """False for most texts without a mention, never for one with: tests that are much cheaper than the pattern, the cheapest first."""
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(r"(?i)token|passw|secret|(?:api|access)[_-]?key")
    return F.coalesce(text.contains("@") | text.rlike(r"\d\d\d|\d\.\d|\+\d|[A-Z][A-Z]\d\d") | assigned | text.rlike(TITLED), F.lit(False))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind_of(mention: Column) -> Column:
    """Type of a mention, by the same patterns in the same order; "plain" where check digits do not hold.  A secret is what nothing else is: its
    pattern looks at what stands before it."""
    out = F.when(mention.contains("@"), "email").when(mention.rlike(rf"^(?:{PATTERNS['ip']})$"), "ip")
    iban = F.regexp_replace(mention, " ", "")
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    out = out.when(mention.rlike(rf"^(?:{PATTERNS['iban']})$"), F.when(_mod97(turned) == 1, "iban").otherwise("plain"))
    out = out.when(mention.rlike(rf"^(?:{PATTERNS['card']})$"), F.when(_luhn(_digits(mention)) == 0, "card").otherwise("plain"))
    for name in ("ssn", "phone", "name"):
        out = out.when(mention.rlike(rf"^(?:{PATTERNS[name]})$"), name)
    return out.when(mention.rlike(rf"^(?:{RUN})$"), "run").otherwise("secret")


def canonical(kind: Column, mention: Column) -> Column:
    """The form that all mentions of an entity share.  Secrets differ by case unless they are hexadecimal; a phone number abroad keeps its
    country code, one of the North American plan is its ten digits with or without the code."""
    digits = _digits(mention)
    return (
        F.when(kind == "secret", F.when(mention.rlike("^[0-9A-Fa-f]+$"), F.lower(mention)).otherwise(mention))
        .when(kind == "ip", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "phone", F.when(~mention.startswith("+"), digits).when(digits.rlike(r"^1\d{10}$"), F.substring(digits, 2, 10)).otherwise(F.concat(F.lit("+"), digits)))
        .when(kind.isin("card", "ssn"), digits)
        .otherwise(F.lower(mention))
    )


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Hexadecimal stream of ``BYTES`` keyed bytes."""
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(i))), 256) for i in range(BYTES // 32)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(BYTES)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(first: str, last: str, n: Column) -> Column:
    """The n-th letter from ``first`` to ``last``, counted around."""
    point = F.pmod(n, F.lit(ord(last) - ord(first) + 1)) + ord(first)
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _alike(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter or digit replaced by a keyed one of its own script; anything else stays."""

    def one(c: Column, i: Column) -> Column:
        wide = _byte(stream, i) * 256 + _byte(stream, i + 61)
        out = F.when(hexadecimal & c.between("0", "f"), F.lower(F.hex(wide % 16))).when(c.between("0", "9"), (wide % 10).cast("string"))
        out = out.when(F.lit(GREEK_ACCENTS).contains(c), _letter("κ", "ρ", wide))  # an accented letter turns into one that has no accents
        for first, last in SCRIPTS:
            out = out.when(c.between(first, last), _letter(first, last, wide))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, modulo 10."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, b: a + b) % 10


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and capital letters (A is 10) read as one number."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


# Consonants and vowels of made-up names, and endings of a female, a male and any other name, by the first letter they are for.
SOUNDS = (
    (r"[Ѐ-ӿ]", "бвгдзклмнпрст", "аеиоу", ("на", "н", "рк")),
    (r"[Ͱ-Ͽἀ-῿]", "βγδκλμνπρστφ", "αειου", ("να", "ς", "ρη")),
    (r"[A-Za-zÀ-ɏ]", "bdfgklmnprstv", "aeiou", ("na", "n", "rk")),
)


def name_part(token: Column, gender: Column, stream: Column, attempt: Column, alike: Column) -> Column:
    """A name of three syllables and one more for each attempt, in the token's script; a given name (gender "f" or "m") ends as such names do.
    In other scripts it is ``alike``: each letter has its own replacement, and the attempt's number of letters follows."""
    least = F.least(attempt, F.lit(12))

    def syllable(consonants: str, vowels: str):
        pick = lambda of, i: F.substring(F.lit(of), (_byte(stream, i) % len(of) + 1).cast("int"), F.lit(1))
        return lambda i: F.concat(pick(consonants, 2 * i), pick(vowels, 2 * i + 1))

    out = None
    for script, consonants, vowels, (female, male, other) in SOUNDS:
        base = F.array_join(F.transform(F.sequence(F.lit(0), least + 2), syllable(consonants, vowels)), "")
        base = F.concat(base, F.when(gender == "f", female).when(gender == "m", male).otherwise(other))
        out = F.when(token.rlike("^" + script), base) if out is None else out.when(token.rlike("^" + script), base)
    return out.otherwise(alike)


def draw(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    """Surrogate of an entity, in canonical form, by its keyed ``stream``; of an e-mail address only the part before the domain."""
    at = lambda i: _byte(stream, F.lit(i))
    parts = F.split(canon, r"\|")
    given = F.when(kind == "email", F.regexp_extract(canon, "^(.*)@", 1)).when(kind == "domain", F.regexp_replace(canon, r"\.[^.]*$", ""))
    given = given.when(kind == "iban", F.lower(F.substring(canon, F.lit(5), F.length(canon))))
    given = given.when(kind == "name", F.concat(parts[0], F.repeat(F.substring(parts[0], -1, 1), F.least(attempt, F.lit(12))))).otherwise(canon)
    alike = _alike(given, stream, (kind == "secret") & canon.rlike("^[0-9a-f]+$"))
    ip = F.concat_ws(".", (at(0) % 223 + 1).cast("string"), *(at(i).cast("string") for i in (1, 2)), (at(3) % 254 + 1).cast("string"))
    card = F.concat(F.substring(canon, 1, 1), F.substring(alike, F.lit(2), F.length(canon) - 2))
    card = F.concat(card, ((10 - _luhn(F.concat(card, F.lit("0")))) % 10).cast("string"))
    account, country = F.upper(alike), F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    code = F.regexp_extract(canon, COUNTRY, 0)
    ours = F.concat((at(100) % 8 + 2).cast("string"), F.substring(alike, F.lit(2), F.length(canon)))
    phone = F.when(code == "", ours).otherwise(F.concat(code, F.substring(alike, F.length(code) + 1, F.length(canon))))
    ssn = F.concat((at(100) % 8 + 1).cast("string"), F.substring(alike, F.lit(2), F.length(canon)))
    name = F.lower(name_part(parts[0], parts[1], stream, attempt, alike))
    out = F.when(kind == "domain", F.concat(alike, F.regexp_extract(canon, r"\.[^.]*$", 0))).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
    out = out.when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "name", name).otherwise(alike)
    more = F.greatest(attempt - LONGER, F.lit(0))
    hexadecimal = F.substring(stream, 1, 64)
    tail = F.when(kind.isin("card", "phone", "ssn", "ip"), F.translate(hexadecimal, "abcdef", "012345")).otherwise(F.translate(hexadecimal, "0123456789", "ghijklmnop"))
    tail = F.substring(tail, F.lit(1), more)
    return F.when(kind == "domain", F.concat(tail, out)).otherwise(F.concat(out, tail))


def _fill(mention: Column, chars: Column, digit: str) -> Column:
    """The mention with its characters of class ``digit`` replaced, in order, by the last ones of ``chars``; what is left of ``chars`` follows."""
    own = F.regexp_replace(mention, f"[^{digit}]", "")
    full = F.concat(F.substring(own, F.lit(1), F.greatest(F.length(own) - F.length(chars), F.lit(0))), chars)

    def put(acc: Column, c: Column) -> Column:
        hit = c.rlike(f"[{digit}]")
        return F.struct(F.concat(acc["out"], F.when(hit, F.substring(full, acc["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(hit, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda a: F.concat(a["out"], F.substring(full, a["k"], F.length(full))))


def _cased(mention: Column, surrogate: Column) -> Column:
    """The surrogate in capitals where the mention is; what is longer keeps its case."""
    each = F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)) != F.lower(F.substring(mention, i + 1, F.lit(1))), F.upper(c)).otherwise(c))
    return F.when(F.lower(mention) == mention, surrogate).when(F.upper(mention) == mention, F.upper(surrogate)).otherwise(F.array_join(each, ""))


def in_format(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate written as the mention is: its separators, its capitals."""
    loud = (F.upper(mention) == mention) & (F.length(mention) > 1)
    return (
        F.when(kind.isin("card", "ssn"), _fill(mention, surrogate, "0-9"))
        .when(kind == "phone", _fill(mention, F.regexp_replace(surrogate, r"\+", ""), "0-9"))
        .when(kind == "iban", _fill(mention, surrogate, "A-Z0-9"))
        .when(kind == "ip", surrogate)
        .when(kind == "name", F.when(loud & (F.lower(mention) != mention), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))))
        .when((kind == "secret") & ~mention.rlike("^[0-9A-Fa-f]+$"), surrogate)
        .otherwise(_cased(mention, surrogate))
    )


def distinct_surrogates(entities: DataFrame, key: str, scratch: Scratch, rows_per_task: int = 4000, max_rounds: int = 120) -> DataFrame:
    """``(kind, canon, surrogate)`` for the distinct ``entities(kind, canon)``; no two of a kind share a surrogate and none is an
    entity of that kind itself.  A name's gender is part of its canonical form; an address's local part is distinct within its domain.

    Each round draws for those that still lack a surrogate, in tasks of about ``rows_per_task``."""
    domain = F.when(F.col("kind") == "email", F.regexp_extract("canon", "@.*$", 0)).otherwise(F.lit(""))
    bare = F.when(F.col("kind") == "name", F.element_at(F.split("canon", r"\|"), 1)).when(F.col("kind") == "email", F.regexp_extract("canon", "^(.*)@", 1)).otherwise(F.col("canon"))
    open_ = scratch.table(entities.select("kind", "canon", domain.alias("domain"), bare.alias("real"), F.lit(0).alias("attempt")))
    known = open_.select("kind", "domain", F.col("real").alias("surrogate")).distinct()
    settled = None
    for _ in range(max_rounds):
        n = open_.count()
        if not n:
            break
        dealt = open_.repartition(min(10_000, -(-n // rows_per_task)), "kind", "canon")
        dealt = dealt.withColumn("stream", _stream(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        drawn = scratch.table(dealt.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("stream"))).drop("stream"))
        # The attempt is a column, so that all rounds run the same code.  Who drew earlier keeps a surrogate; of those that draw at once the first by canonical form.
        taken = known if settled is None else known.unionAll(settled.select("kind", "domain", "surrogate"))
        first = drawn.groupBy("kind", "domain", "surrogate").agg(F.min("canon").alias("canon"))
        first = scratch.table(first.join(taken, ["kind", "domain", "surrogate"], "left_anti"))
        settled = first if settled is None else settled.unionByName(first)
        open_ = drawn.select("kind", "canon", "domain", "real", (F.col("attempt") + 1).alias("attempt")).join(first.select("kind", "canon"), ["kind", "canon"], "left_anti")
        open_ = scratch.table(open_)
    else:
        raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")
    if settled is None:
        return entities.select("kind", "canon", F.col("canon").alias("surrogate"))
    return settled.select("kind", "canon", "surrogate")


def _pieces(kind: Column, mention: Column) -> Column:
    """What a mention consists of, each with the text before it: titles and names, or local part and domain, or the mention itself."""

    def piece(lead, text, canon, of, begins):
        return F.struct(lead.alias("lead"), text.alias("piece"), canon.alias("canon"), of.alias("kind"), begins.alias("begins"))

    titles = F.regexp_extract(mention, rf"^(?:(?:{TITLES})\.? ){{1,3}}(?=[\p{{Lu}}\p{{Lo}}])", 0)
    words = F.split(F.substring(mention, F.length(titles) + 1, F.length(mention)), " ")
    gender = F.when(titles.rlike(rf"(?:^| )(?:{FEMALE_TITLES})\.? "), "f").when(titles.rlike(rf"(?:^| )(?:{MALE_TITLES})\.? "), "m").otherwise("n")
    named = F.transform(words, lambda w, i: piece(F.when(i == 0, titles).otherwise(F.lit(" ")), w, F.concat_ws("|", F.lower(w), F.when((F.size(words) == 2) & (i == 0), gender).otherwise("s")), F.lit("name"), i == 0))
    run = F.transform(F.split(mention, " "), lambda w, i: piece(F.when(i == 0, F.lit("")).otherwise(F.lit(" ")), w, F.lit(None).cast("string"), F.lit("run"), F.lit(False)))
    at = F.regexp_extract(mention, "@.*$", 0)
    domain = F.substring(at, F.lit(2), F.length(at))
    email = F.array(
        piece(F.lit(""), F.regexp_extract(mention, "^(.*)@", 1), F.lower(mention), F.lit("email"), F.lit(True)),
        piece(F.lit("@"), domain, F.lower(domain), F.lit("domain"), F.lit(False)),
    )
    whole = F.array(piece(F.lit(""), mention, canonical(kind, mention), kind, kind != "plain"))
    return F.when(kind == "name", named).when(kind == "run", run).when(kind == "email", email).otherwise(whole)


def _titled_names(rows: DataFrame) -> DataFrame:
    """``(pair, gender)`` of the full names that stand after a title anywhere: the pair in lower case; "n" where no title tells a gender."""
    names = rows.filter(F.coalesce(F.col("text").rlike(TITLED), F.lit(False))).select(F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("mention"))
    parts = names.filter(F.col("mention").rlike(rf"^(?:{PATTERNS['name']})$")).select(_pieces(F.lit("name"), F.col("mention")).alias("p")).filter(F.size("p") == 2)
    gender = F.element_at(F.split(F.col("p")[0]["canon"], r"\|"), 2)
    pair = F.concat_ws(" ", F.lower(F.col("p")[0]["piece"]), F.lower(F.col("p")[1]["piece"]))
    return parts.groupBy(pair.alias("pair")).agg(F.min(gender).alias("gender"))


def _named_without_title(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pieces of runs of capitalised words that make up one of the ``known`` names, as names; the others as plain text."""
    runs = found.filter("kind = 'run'")
    order = Window.partitionBy("row", "pos").orderBy("k")
    runs = runs.withColumn("after", F.lower(F.concat_ws(" ", "piece", F.lead("piece").over(order)))).withColumn("before", F.lower(F.concat_ws(" ", F.lag("piece").over(order), "piece")))
    runs = runs.join(known.select(F.col("pair").alias("after"), F.col("gender").alias("given")), "after", "left")
    runs = runs.join(known.select(F.col("pair").alias("before"), F.lit(True).alias("family")), "before", "left")
    canon = F.when(F.col("given").isNotNull(), F.concat_ws("|", F.lower("piece"), "given")).when(F.col("family"), F.concat_ws("|", F.lower("piece"), F.lit("s")))
    return runs.select("row", "pos", "k", "lead", "piece", canon.alias("canon"), F.when(canon.isNotNull(), "name").otherwise("plain").alias("kind"), F.col("given").isNotNull().alias("begins"))


def replace_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "kindred") -> DataFrame:
    """``(doc_id, text, n_mentions, kinds)`` for every row: the whole text with each mention replaced, the number of mentions and their types in
    order.  Found are e-mail addresses, assigned secrets, IP addresses, IBANs and card numbers with valid check digits, social security and phone numbers,
    names after a title, and the full names so found wherever they stand without one.

    An entity has one surrogate throughout the corpus, whatever the format of its mentions; the same key gives
    the same surrogates.  Given names and surnames are replaced each for itself, so a short and a full form agree; so are local part
    and domain of an address.  The gender of a name after a neutral title is the one that other titles tell.  Mentions that tie for a place go by the order of
    ``PATTERNS``; the longest match from the first place counts.  Null texts stay
    null, empty texts empty; very long texts are searched whole.  Null ids and repeated rows are rows like any other; equal texts come out equal.  An empty table gives no rows.  Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = scratch.table(_titled_names(rows))
    any_names = bool(known.limit(1).count())
    nothing = F.array().cast("array<string>")
    found_by = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pattern = MENTION
    rows = rows.withColumn("mentions", F.when(may_hold(F.col("text")), found_by(MENTION)).otherwise(nothing)).withColumn("named", F.lit(False))
    if any_names:
        # Texts with a known name, by hash: a text of another's hash is only searched in vain.
        pattern = f"{MENTION}|(?:{RUN})"
        plain = docs.select(F.xxhash64(text_col).alias("hash"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
        words = F.split(F.lower("run"), " ")
        pairs = plain.select("hash", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).alias("pair")).distinct()
        hits = scratch.table(pairs.join(known.select("pair"), "pair").select("hash").distinct())
        rows = rows.withColumn("hash", F.xxhash64("text")).join(hits.withColumn("hit", F.lit(True)), "hash", "left").drop("hash")
        rows = rows.withColumn("named", F.coalesce("hit", F.lit(False))).withColumn("mentions", F.when(F.col("named"), found_by(pattern)).otherwise(F.col("mentions"))).drop("hit")
    none = rows.filter(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).alias("n_mentions"), nothing.alias("kinds"))
    gaps = F.when(F.col("named"), F.split("text", pattern, -1)).otherwise(F.split("text", MENTION, -1))
    held = rows.filter(F.size("mentions") > 0).select("doc_id", gaps.alias("gaps"), "mentions")
    held = scratch.table(held.withColumn("row", F.monotonically_increasing_id()))

    found = held.select("row", F.posexplode("mentions").alias("pos", "mention"))
    found = found.select("row", "pos", F.posexplode(_pieces(kind_of(F.col("mention")), F.col("mention"))).alias("k", "p"))
    found = scratch.table(found.select("row", "pos", "k", "p.lead", "p.piece", "p.canon", "p.kind", "p.begins"))
    if any_names:
        named = _named_without_title(found, known)
        found = found.filter("kind <> 'run'").unionByName(named)
        # A given name after a neutral title has the gender that other titles tell, if they agree.
        given = F.regexp_extract("canon", r"^(.*)\|[nfm]$", 1)
        told = found.filter((F.col("kind") == "name") & F.col("canon").rlike(r"\|[fm]$")).groupBy(given.alias("given")).agg(F.min(F.substring("canon", -1, 1)).alias("low"), F.max(F.substring("canon", -1, 1)).alias("high"))
        told = told.filter("low = high").select(F.concat_ws("|", "given", F.lit("n")).alias("canon"), F.concat_ws("|", "given", "low").alias("better"))
        found = found.join(told, "canon", "left").withColumn("canon", F.coalesce("better", "canon")).drop("better")
        found = scratch.table(found)
    surrogates = distinct_surrogates(found.filter("kind <> 'plain'").select("kind", "canon").distinct(), key, scratch)
    found = found.join(surrogates, ["kind", "canon"], "left")
    new = F.when(F.col("kind") == "plain", F.col("piece")).otherwise(in_format(F.col("kind"), F.col("piece"), F.col("surrogate")))
    found = found.withColumn("new", new).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "kind", "lead", "new", "begins"))).alias("all"))

    texts = F.transform("all", lambda x: F.concat(F.when(x["k"] == 0, F.element_at("gaps", x["pos"] + 1)).otherwise(F.lit("")), x["lead"], x["new"]))
    kinds = F.transform(F.filter("all", lambda x: x["begins"]), lambda x: x["kind"])
    rebuilt = held.join(found, "row").select("doc_id", F.concat(F.array_join(texts, ""), F.element_at("gaps", -1)).alias("text"), F.size(kinds).alias("n_mentions"), kinds.alias("kinds"))
    return none.unionAll(rebuilt)


def op4_surrogates(spark, sf_dir):
    return replace_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op4_surrogates": op4_surrogates}

import re

import pytest

from kindred.llm import surrogates as S

from .helpers import documents, empty_documents, odd_documents

TEXTS = [
    "Mail a.bc9@mail.example.com or A.BC9@MAIL.EXAMPLE.COM.",
    "call +1 (017) 555-7713!! or 017-555-7713, not 12-34",
    "hosts 10.0.0.255, 97.51.17.173. v1.2.3 and 300.1.1.1",
    "cards 4242424242424242 4242 4242 4242 4242 and 5555555555554444",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" PASSWORD: Secret_99_value',
    "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789",
    "Mr. John Smith met Mrs Smith and Frau Anna Müller; Г-н Пушкин. MR. JOHN SMITH",
    "nothing here",
    "$1 \\1 a@b.co $0",
    "a@b.co",
]


@pytest.fixture(scope="module")
def out(spark):
    return {r["doc_id"]: r for r in S.replace_personal_data(documents(spark, TEXTS)).collect()}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def test_kinds(out):
    kinds = {i: list(r["kinds"]) for i, r in out.items()}
    assert kinds[0] == ["email"] * 2
    assert kinds[1] == ["phone"] * 2
    assert kinds[2] == ["ip"] * 2
    assert kinds[3] == ["card"] * 3
    assert kinds[4] == ["secret"] * 2
    assert kinds[5] == ["iban", "ssn"]
    assert kinds[6] == ["name"] * 5
    assert kinds[7] == []
    assert len(out) == len(TEXTS)


def test_nothing_of_the_original_is_left(out):
    for secret in ("bc9@", "BC9@", "555-7713", "10.0.0.255", "97.51.17.173", "4242424242424242", "04dbebab", "Secret_99", "3704", "123-45", "Smith", "SMITH", "Müller", "Пушкин"):
        assert not any(secret in r["text"] for r in out.values()), secret


def test_format_and_coreference(out):
    lower, upper = re.fullmatch(r"Mail (\S+) or (\S+)\.", out[0]["text"]).groups()
    assert upper == lower.upper() and re.fullmatch(r"[a-z]\.[a-z]{2}\d@[a-z]{4}\.[a-z]{7}\.com", lower)
    a, b, c, d = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4})!! or (\d{3})-(\d{3}-\d{4}), not 12-34", out[1]["text"]).groups()
    assert (a, b) == (c, d)
    plain, spaced, other = re.fullmatch(r"cards (\d{16}) (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", out[3]["text"]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain[0] == "4" and other != plain
    assert re.fullmatch(r'token = "[0-9a-f]{40}" PASSWORD: [A-Za-z]{6}_\d\d_[a-z]{5}', out[4]["text"])
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", out[5]["text"])[0].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    octets = re.search(r"hosts (\S+), (\S+)\. v1\.2\.3 and 300\.1\.1\.1", out[2]["text"]).groups()
    assert all(0 <= int(x) <= 255 for o in octets for x in o.split("."))


def test_names(out):
    john, smith, again, anna, _, poet, loud, louder = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs (\S+) and Frau (\S+) (\S+); Г-н (\S+)\. MR\. (\S+) (\S+)", out[6]["text"].replace("; Г-н", "; Г-н")).groups()
    assert smith == again and (john.upper(), smith.upper()) == (loud, louder)
    assert john.endswith("n") and not john.endswith("na") and anna.endswith("na")
    assert re.fullmatch("[А-Я][а-я]+", poet)


def test_marks_of_replacement_strings_are_harmless(out):
    email = out[9]["text"]
    assert out[8]["text"] == f"$1 \\1 {email} $0"


def test_keyed_and_repeatable(spark, out):
    docs = documents(spark, TEXTS)
    again = {r["doc_id"]: r["text"] for r in S.replace_personal_data(docs.repartition(3)).collect()}
    assert again == {i: r["text"] for i, r in out.items()}
    other = {r["doc_id"]: r["text"] for r in S.replace_personal_data(docs, key="other").collect()}
    assert other[3] != again[3] and other[7] == again[7]


SAMPLES = {
    "email": ["a@b.co", "Ä.b@c-d.e.org"],
    "secret": ["token=abcdefghijkl", 'PassWord" : "abcdefghijkl', "api-key:abcd_efgh-ijk", "apikey=abcdefghijkl", "ACCESS_KEY = abcdefghijkl", "passwd=abcdefghijkl", "api_key:abcdefghijkl", "secret=abcdefghijkl"],
    "ip": ["1.2.3.4", "10.20.30.40"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBKABCDEFGH", "MT84 MALT ABCD EFGH", "FR76 AB12 CD34 EF56"],
    "card": ["4242 4242 4242 4242", "1234567890123"],
    "ssn": ["123-45-6789"],
    "phone": ["+49 30 12 34 56 78", "+33-12-34-56-78", "+1.22.33", "+4930", "+12345", "+1 (017) 555-7713", "(01) 555 7713", "017 555 7713", "+7 (12)345 6789"],
    "name": ["Mr A'b", "Frau. Öl", "Г-жа Ян", "SIG. XY", "Dr Ba", "Frau Prof. Dr. Li", "Mr 山田 太郎", "Κυρία Παπά"],
}


def test_whatever_a_pattern_matches_is_looked_at(spark):
    """Each pattern's matches pass the cheap test, in a text without anything else that would."""
    from pyspark.sql import functions as F

    rows = [(k, x, f"see {x} there") for k, all_ in SAMPLES.items() for x in all_]
    df = spark.createDataFrame(rows, "kind string, sample string, text string")
    tests = [F.col("text").rlike(p).alias(k) for k, p in S.PATTERNS.items()]
    got = df.select("kind", "sample", S.may_hold(F.col("text")).alias("held"), *tests).collect()
    for k in S.PATTERNS:
        assert any(r[k] and r["kind"] == k for r in got), k
    assert [r["sample"] for r in got if any(r[k] for k in S.PATTERNS) and not r["held"]] == []
    docs = documents(spark, ["call +49 30 12 34 56 78 now", "in 2024 call +49 30 12 34 56 78 now"])
    a, b = (r["text"] for r in S.replace_personal_data(docs).orderBy("doc_id").collect())
    assert "12 34 56 78" not in a and a.split("call ")[1] == b.split("call ")[1]


def test_collisions_are_drawn_again(spark):
    """Two-digit numbers have 100 surrogates at most: 40 entities cannot all draw a free one at once."""
    from kindred.llm.shared import Scratch

    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(40)], "kind string, canon string")
    got = S.distinct_surrogates(entities, "k", Scratch(spark, "t"), max_rounds=500).collect()
    assert len({r["surrogate"] for r in got}) == 40
    assert not {r["surrogate"] for r in got} & {r["canon"] for r in got}


ODD_MENTIONS = [
    "Password: ------------ and password=____________",
    "mail 山田@例え.テスト, 山田@例え.テスト",
    "mail ½@½.ⅷⅷ and Ⅷ@Ⅷ.ab",
    "Mr John Smith, Dr. Eva Braun, Frau Eva Braun, Frau Dr. Eva Braun",
    "Yesterday John Smith met Eva Braun Today. JOHN SMITH left",
    "Ms Αννα Παπά",
    "token=AbCdEfGh1234 token=abcdefgh1234 token=DEADBEEF0123 token=deadbeef0123",
    "+1 202 555 0123 and +44 202 555 0123, 202-555-0123, +44 (202) 5550123",
    "a1@foo.com b2@foo.com c3@bar.com Foo@FOO.com",
    "DE88 3704 0044 0532 0130 00 and 4242424242424241 1234567812345678",
    "Mr Ли Пэн and Mr 山田 太郎, 山田 太郎",
]


def test_odd_mentions(spark):
    out = {r["doc_id"]: r for r in S.replace_personal_data(documents(spark, ODD_MENTIONS)).collect()}
    text = lambda i: out[i]["text"]
    assert text(0) == ODD_MENTIONS[0] and out[0]["n_mentions"] == 0
    a, b = text(1)[5:].split(", ")
    assert a == b != "山田@例え.テスト" and re.fullmatch("[一-鿿]{2}@[一-鿿][ぁ-ゖ].テスト", a)
    # Names: a neutral title takes the gender that another tells; untitled repeats and capitals are found.
    john, smith, eva, braun, *more = re.fullmatch(r"Mr (\S+) (\S+), Dr\. (\S+) (\S+), Frau (\S+) (\S+), Frau Dr\. (\S+) (\S+)", text(3)).groups()
    assert more == [eva, braun] * 2 and eva.endswith("na") and john.endswith("n")
    assert text(4) == f"Yesterday {john} {smith} met {eva} {braun} Today. {john.upper()} {smith.upper()} left"
    assert out[4]["kinds"] == ["name"] * 3
    assert re.fullmatch("Ms [Ͱ-Ͽ]+να [Ͱ-Ͽ]+", text(5)) and "Αννα" not in text(5)
    # Secrets: case is kept and tells entities apart, but not hexadecimal ones.
    one, two, loud, quiet = re.findall(r"=(\S+)", text(6))
    assert re.fullmatch("(?:[A-Z][a-z]){4}[0-9]{4}", one) and two == two.lower() != one.lower() and loud == quiet.upper()
    ours, abroad, again, other = re.fullmatch(r"\+1 (\S+ \S+ \S+) and \+44 (\S+ \S+ \S+), (\S+), \+44 \((.*)", text(7)).groups()
    assert ours.replace(" ", "-") == again and ours != abroad and other.replace(") ", "") == abroad.replace(" ", "")
    foo, same, bar, shout = re.findall(r"@(\S+)", text(8))
    assert foo == same == shout.lower() != bar
    # Check digits that do not hold are no card and no account.
    assert text(9) == ODD_MENTIONS[9] and out[9]["kinds"] == []
    assert re.fullmatch(r"Mr [А-я]+ [А-я]+ and Mr ([一-鿿]+ [一-鿿]+), \1", text(10)) and "山田" not in text(10)


def test_names_do_not_run_out(spark):
    """More surnames than names of three syllables."""
    from pyspark.sql import functions as F

    from kindred.llm.shared import Scratch

    entities = spark.range(300_000).select(F.lit("name").alias("kind"), F.concat(F.lit("entity"), F.col("id"), F.lit("|s")).alias("canon"))
    got = S.distinct_surrogates(entities, "k", Scratch(spark, "names"))
    assert got.agg(F.count("*"), F.countDistinct("surrogate"), F.countDistinct("canon")).first() == (300_000,) * 3


class Plain:
    """The whole query in plain Python, for texts in Latin letters."""

    def __init__(self, texts, key="kindred"):
        import hashlib

        import regex

        self.regex, self.sha, self.key = regex, hashlib.sha256, key
        self.mention = regex.compile(S.MENTION, regex.ASCII)
        self.kinds = {k: regex.compile(p, regex.ASCII) for k, p in S.PATTERNS.items()}
        self.texts = texts

    def stream(self, kind, canon, attempt):
        return b"".join(self.sha("|".join([self.key, kind, canon, str(attempt), str(i)]).encode()).digest() for i in range(4))

    def alike(self, text, stream, hexadecimal=False):
        out = ""
        for i, c in enumerate(text):
            n = stream[i % 128] * 256 + stream[(i + 61) % 128]
            if hexadecimal and "0" <= c <= "f":
                out += "0123456789abcdef"[n % 16]
            else:
                first, last = next(((a, b) for a, b in ("09", *S.SCRIPTS) if a <= c <= b), (c, c))
                out += chr(ord(first) + n % (ord(last) - ord(first) + 1))
        return out

    @staticmethod
    def mod97(x):
        return int("".join(str(int(c, 36)) for c in x)) % 97

    def pieces(self, m):
        """(kind of mention or None, [(kind, canon, text before, text)])"""
        squeezed = m.replace(" ", "")
        full = lambda k: self.kinds[k].fullmatch(m)
        if "@" in m:
            local, domain = m.rsplit("@", 1)
            return "email", [("email", m.lower(), "", local), ("domain", domain.lower(), "@", domain)]
        if full("ip"):
            return "ip", [("ip", m, "", m)]
        if full("iban"):
            return ("iban", [("iban", squeezed, "", m)]) if self.mod97(squeezed[4:] + squeezed[:4]) == 1 else (None, [(None, None, "", m)])
        digits = re.sub(r"\D", "", m)
        if full("card"):
            return ("card", [("card", digits, "", m)]) if luhn(digits) else (None, [(None, None, "", m)])
        if full("ssn"):
            return "ssn", [("ssn", digits, "", m)]
        if full("phone"):
            ours = digits[1:] if re.fullmatch(r"1\d{10}", digits) else "+" + digits
            return "phone", [("phone", ours if m[0] == "+" else digits, "", m)]
        assert not full("name"), "the given tables hold none"
        return "secret", [("secret", m.lower() if re.fullmatch("[0-9A-Fa-f]+", m) else m, "", m)]

    def draw(self, kind, canon, attempt):
        assert attempt <= S.LONGER
        s = self.stream(kind, canon, attempt)
        alike = self.alike(canon, s)
        if kind == "email":
            return self.alike(canon.rsplit("@", 1)[0], s)
        if kind == "domain":
            name, top = canon.rsplit(".", 1)
            return self.alike(name, s) + "." + top
        if kind == "ip":
            return f"{s[0] % 223 + 1}.{s[1]}.{s[2]}.{s[3] % 254 + 1}"
        if kind == "card":
            body = canon[0] + alike[1:-1]
            return next(body + d for d in "0123456789" if luhn(body + d))
        if kind == "iban":
            account = self.alike(canon[4:].lower(), s).upper()
            return f"{canon[:2]}{98 - self.mod97(account + canon[:2] + '00'):02d}{account}"
        if kind == "phone":
            code = re.match(S.COUNTRY, canon)
            return code[0] + alike[code.end() :] if code else str(s[100] % 8 + 2) + alike[1:]
        if kind == "ssn":
            return str(s[100] % 8 + 1) + alike[1:]
        return self.alike(canon, s, bool(re.fullmatch("[0-9a-f]+", canon)))

    def surrogates(self, entities):
        scope = lambda e: (e[0], e[1][e[1].rindex("@") :] if e[0] == "email" else "")
        real = {(scope(e), e[1].rsplit("@", 1)[0] if e[0] == "email" else e[1]) for e in entities}
        out, taken, attempt = {}, set(real), 0
        while left := sorted(e for e in entities if e not in out):
            new = set()
            for e in left:
                x = scope(e), self.draw(*e, attempt)
                if x not in taken and x not in new:
                    new.add(x)
                    out[e] = x[1]
            taken |= new
            attempt += 1
        return out

    @staticmethod
    def written(kind, piece, new):
        if kind is None:
            return piece
        if kind in ("card", "ssn", "phone", "iban"):
            own = [c for c in piece if c.isascii() and (c.isdigit() or kind == "iban" and c.isupper())]
            new = new.replace("+", "")
            chars = iter("".join(own[: max(0, len(own) - len(new))]) + new)
            return "".join(next(chars) if c.isascii() and (c.isdigit() or kind == "iban" and c.isupper()) else c for c in piece)
        if kind == "ip" or kind == "secret" and not re.fullmatch("[0-9A-Fa-f]+", piece):
            return new
        return "".join(n.upper() if p != p.lower() else n for p, n in zip(piece, new, strict=True))

    def run(self):
        found = [[(m.span(), *self.pieces(m[0])) for m in self.mention.finditer(t or "")] for t in self.texts]
        new = self.surrogates({(k, c) for ms in found for _, _, ps in ms for k, c, _, _ in ps if k})
        for text, ms in zip(self.texts, found, strict=True):
            out, at = "", 0
            for (a, b), _, ps in ms:
                out += text[at:a] + "".join(lead + self.written(k, piece, new.get((k, c))) for k, c, lead, piece in ps)
                at = b
            yield None if text is None else out + text[at:], [k for _, k, _ in ms if k]


def test_whole_query_equals_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, Plain([r["text"] for r in rows]).run(), strict=True)}
    got = S.op4_surrogates(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["text"], r["kinds"]) for r in got} == want
    assert sum(r["n_mentions"] for r in got) == sum(len(k) for _, k in want.values()) > 50


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = S.replace_personal_data(docs)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
    assert S.replace_personal_data(empty_documents(spark)).count() == 0


def test_only_dataframe_operations(spark):
    plan = S.replace_personal_data(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

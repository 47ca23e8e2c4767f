"""Secret scans: pattern candidates, then a random forest that removes false positives.

Everything runs as DataFrame functions: one regular expression collects candidates
with their surroundings, native functions turn each into features (length,
character transitions, dictionary coverage, path, neighbouring words), and a random
forest of MLlib, trained from labelled findings, gives the probability of a secret.

The labelled findings are a table (value, before, after, path, label), of which a hash
sample of at most ``FINDINGS`` rows is read, half of each label. A label without rows is
filled from ``example_findings``, which makes labelled findings by rule; so an empty table
or one of a single label trains a forest too. ``learn`` labels the candidates of the
documents themselves by weak rules, adds them to the examples and takes the dictionary from the
words of all documents. A candidate that occurs several times in a document is one row
with its first place and its number of occurrences; a value found both after a name and
by its length alone is one row too. Null and empty texts have no candidates; rows of one
doc_id, and rows that are equal, are scanned each for itself; a null path is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.session import Scratch

#: Labelled findings that the forest is trained from where none are given; also the most it reads of a given table.
FINDINGS = 6000
TREES, DEPTH, SEED = 24, 8, 17
#: Size of the found secrets up to which they may be broadcast to the texts.
BROADCAST_BYTES = 8 << 20
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 48

#: Names of secrets, at the end of a longer name as well (DB_PASSWORD), and what stands between a name and its value.
_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private|client)[_-]?(?:key|secret|token))"
_SIGN = r"[\"']?[ \t]*+(?:=>|:=|=|:)[ \t]*+[\"']?"
_LEAD = r"(?=[AaCcPpSsTt])" + _NAME + _SIGN
#: A block runs to its END line over headers and escapes; without one before the next block, the BEGIN line alone.
_PEM = r"-----BEGIN (?:[A-Z]{2,16} ){0,3}PRIVATE KEY-----(?:(?>(?s:.*?)(?=-----(?:BEGIN|END) ))-----END (?:[A-Z]{2,16} ){0,3}PRIVATE KEY-----)?"
#: Kinds with a form of their own. Values run to their end, however long.
FORMS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2}(?:\.[A-Za-z0-9_-]++){0,2}",
}
#: After a name like password a value of a known form ends with that form, unless the text runs on like a value.
_ASSIGNED = rf"{_LEAD}(?:{_PEM}|(?:{'|'.join(FORMS.values())})(?![A-Za-z0-9_~+/=%-]|\.[^\s\"'<>,;])|[^\s\"'<>,;]{{6,}}+)"
#: A long run that is itself the name of an assigned value is no candidate.
_GENERIC = rf"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{20,}}+(?!(?<={_NAME}){_SIGN}[^\s\"'<>,;]{{6}})={{0,2}}"
#: Candidates by kind. A value after a name like password has the kind of its own form, where it has one.
KINDS = FORMS | {"assigned": _ASSIGNED, "generic": _GENERIC}
#: The first letters stand before the names and forms, as most places fail by them at once.
CANDIDATE = rf"(?=[Aegx])\b(?:{'|'.join(FORMS.values())})|{_ASSIGNED}|\b{_GENERIC}|{_PEM}"

#: Words whose letters in a value speak for text or a placeholder (fixed values).
DICTIONARY = (
    "example sample dummy default change replace insert your this that here there with from have will value test demo fake mock placeholder "
    "redacted hidden removed none null undefined todo fixme foo bar baz qux abc xyz qwerty letmein welcome admin administrator user username name "
    "password passwd secret token key api access auth client server service account login email mail host port local localhost path home usr var etc "
    "lib bin src main build release version candidate config settings module package index image static assets font style script data file folder "
    "document report table column string number integer object class method function return public private node python java ruby perl linux windows "
    "the and for not you are was all new one two three four five six seven eight nine zero north south east west time date year month week day hour"
).split()
#: Words of the documents that the dictionary takes in, by the number of documents that have them.
CORPUS_WORDS = 1000


def _spelling(words: list[str]) -> str:
    return "(?i)" + "|".join(sorted(words, key=lambda w: (-len(w), w)))


_NEAR_SECRET = r"(?i)\b(?:pass|pwd|secret|token|credential|key|api|access|auth|bearer|aws|login|private|client)|" + _LEAD + "$"
#: Words of host names and addresses do not count.
_NEAR_OTHER = r"(?i)(?<![@.\w])(?:example|sample|dummy|placeholder|commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|etag|revision|version|build|integrity|fingerprint|url|href|path|file|image|font)\b(?!\.\w)"
_PATH_TEST = r"(?i)(?:^|[/_.-])(?:tests?|specs?|examples?|samples?|fixtures?|docs?|mocks?|demos?|readme|changelog|vendor|node_modules|lock)(?:[/_.-]|$)"
_PATH_CONFIG = r"(?i)\.(?:env|ini|cfg|conf|toml|properties|pem|key|tfvars|ya?ml)$|(?:^|/)(?:config|settings|secrets?|credentials?|deploy|prod)(?:[/_.-]|$)"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(value: Column, before: Column, after: Column, path: Column, words: list[str] | None = None) -> dict[str, Column]:
    """Numbers of a candidate, by name; ``words`` are the dictionary."""
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    letters = F.greatest(_count(value, "[A-Za-z]"), F.lit(1.0))
    classes = _count(value, "(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])")
    sounds = _count(value, "(?i)(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])")
    spelled = F.char_length(value) - F.char_length(F.regexp_replace(value, _spelling(words or DICTIONARY), ""))
    around = F.concat_ws(" ", F.right(before, F.lit(24)), F.left(after, F.lit(8)))
    return {
        "length": n,
        "class_turns": classes / n,
        "sound_turns": sounds / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "digits": _count(value, "[0-9]") / n,
        "upper": _count(value, "[A-Z]") / letters,
        "signs": _count(value, "[^A-Za-z0-9]") / n,
        "hexadecimal": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "grouped": value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-").cast("double"),
        "repeats": _count(value, r"(.)\1{2,}"),
        "runs": _count(value, "(?i)0123|1234|2345|3456|4567|5678|6789|abcd|qwer|asdf"),
        "dictionary": spelled / n,
        "prefixed": value.rlike("^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ|-----BEGIN)").cast("double"),
        "near_secret": before.rlike(_NEAR_SECRET).cast("double"),
        "near_other": around.rlike(_NEAR_OTHER).cast("double"),
        "assigned": before.rlike(r"(?::|=|=>)[ \t]*[\"']?$").cast("double"),
        "path_test": path.rlike(_PATH_TEST).cast("double"),
        "path_config": path.rlike(_PATH_CONFIG).cast("double"),
    }


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``(doc_id, path, mark, kind, value, before, after, position, occurrences)``: position is the first, from 1; ``mark`` stands for the row's text."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col(key).alias("doc_id"), where.alias("path"), F.col(text).alias("text"), _mark(F.col(text)).alias("mark"), F.monotonically_increasing_id().alias("row"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))

    def cut(match: Column) -> Column:
        lead = F.regexp_extract(match, rf"^(?:{_LEAD})(?=[^\s])", 0)
        value = match.substr(F.char_length(lead) + 1, F.char_length(match))
        at = F.instr(F.col("text"), match) + F.char_length(lead)
        low = F.greatest(at - NEAR, F.lit(1))
        size = F.char_length(value)
        kind = F.when(value.startswith("-----BEGIN "), "private_key").when(F.char_length(lead) > 0, "assigned").otherwise("generic")
        for name, pattern in FORMS.items():
            kind = F.when(value.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
        return F.struct(
            kind.alias("kind"),
            value.alias("value"),
            F.substring(F.col("text"), low, at - low).alias("before"),
            F.substring(F.col("text"), at + size, F.lit(NEAR)).alias("after"),
            at.cast("long").alias("position"),
            ((F.char_length("text") - F.char_length(F.replace(F.col("text"), value, F.lit("")))) / size).cast("long").alias("occurrences"),
        )

    # The pattern stays within the generator: as a column of its own it would be searched again by the filter that is inferred from it.
    cuts = rows.select("row", "doc_id", "path", "mark", F.inline(F.transform(found, cut)))
    # One row for each row of a document and place: a value after a name goes before the same value alone.
    once = cuts.groupBy("row", "position", "value").agg(F.min(F.struct("kind", "doc_id", "path", "mark", "before", "after", "occurrences")).alias("c"))
    return once.select("c.doc_id", "c.path", "c.mark", "c.kind", "value", "c.before", "c.after", "position", "c.occurrences")


def _mark(text: Column) -> Column:
    """Two hashes and the length of a text: rows of one id and one mark hold the same secrets."""
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.char_length(text).alias("n"))


def corpus_words(docs: DataFrame, n: int = CORPUS_WORDS, text: str = "text") -> list[str]:
    """The n words of four to twelve letters that most documents have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z])[a-z]{4,12}+(?![a-z])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counts.where("n > 1").orderBy(F.desc("n"), "word").limit(n).collect()]


def weak_findings(docs: DataFrame, words: list[str] | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``(value, before, after, path, label)`` of the documents' candidates that rules can label.

    A value after a secret's name, or of a known form, is a secret unless it is spelled from
    words or of few characters; what is so, and digests beside words for them, are none. Others
    have no label.
    """
    rows = candidates(docs, key, text, path)
    made = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), words)
    dull = (made["dictionary"] >= 0.6) | (F.size(F.array_distinct(F.split(F.col("value"), ""))) <= 5) | F.col("value").rlike(r"(.)\1{5}")
    named = (F.col("kind") != "generic") & (made["near_other"] == 0)
    label = F.when(dull, 0).when(named, 1).when((F.col("kind") == "generic") & (made["near_other"] > 0), 0)
    return rows.select("value", "before", "after", "path", label.alias("label")).where("label IS NOT NULL")


def _drawn(size: Column, alphabet: str, salt: str) -> Column:
    """A string of ``size`` letters of an alphabet, drawn by hashes of the row's number."""
    letter = lambda j: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64("id", j, F.lit(salt)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), letter), "")


def _pick(options: list[str], salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))


def example_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings by rule: secrets of several kinds, and what scanners often take for one."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, mixed = "0123456789abcdef", lower + upper + digits
    between = lambda a, b, salt: F.lit(a) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(b - a + 1))
    secrets = [
        F.concat(F.lit("AKIA"), _drawn(F.lit(16), upper + digits, "a")),
        F.concat(F.lit("ghp_"), _drawn(F.lit(36), mixed, "b")),
        F.concat(F.lit("xoxb-"), _drawn(F.lit(12), digits, "c"), F.lit("-"), _drawn(F.lit(24), mixed, "d")),
        F.concat(F.lit("eyJ"), _drawn(between(20, 60, "e"), mixed + "_-", "f"), F.lit("."), _drawn(between(40, 160, "g"), mixed, "h"), F.lit("."), _drawn(F.lit(43), mixed + "_-", "i")),
        _drawn(between(10, 24, "j"), mixed + "!#%&*+", "k"),
        _drawn(between(14, 40, "l"), hexes, "m"),
        _drawn(between(24, 64, "n"), mixed + "+/", "o"),
    ]
    words = [_pick(DICTIONARY, f"w{i}") for i in range(5)]
    others = [
        F.concat(F.lit("AKIA"), _pick(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000", "EXAMPLEKEY000000", "ABCDEFGHIJKLMNOP"], "p")),
        F.concat(F.lit("ghp_"), F.repeat(_pick(["x", "0", "a", "abcd12"], "q"), F.lit(36)).substr(1, 36)),
        F.concat_ws("-", *words[:3], _drawn(F.lit(2), digits, "r"), words[3]),
        F.concat_ws("/", words[0], words[1], _drawn(F.lit(1), digits, "s"), words[2], words[3], words[4]),
        F.concat(words[0], _pick(["123", "1234", "2024", "_here", "-goes-here", "1", "12345678"], "t"), words[1]),
        F.concat_ws("-", _drawn(F.lit(8), hexes, "u"), _drawn(F.lit(4), hexes, "v"), _drawn(F.lit(4), hexes, "w"), _drawn(F.lit(4), hexes, "x"), _drawn(F.lit(12), hexes, "y")),
        _drawn(_pick(["32", "40", "64"], "z").cast("int"), hexes, "A"),
    ]
    row = F.pmod(F.floor(F.col("id") / 2), F.lit(len(secrets))).cast("int") + 1
    neutral = ["and the ", "ring with the ", "une de la ", "der und ein ", "\n", ""]
    leading = ["password=", "secret: ", "api_key = \"", "token=", "aws key ", "Authorization: Bearer "]
    digest = ["commit ", "sha256: ", "md5 checksum ", "uuid=", "file path ", "image url ", "example "]
    secret = F.col("id") % 2 == 0
    kind_five = F.pmod(F.floor(F.col("id") / 2), F.lit(7)).isin(4, 5)
    before = F.when(secret & kind_five, _pick(leading, "B")).when(secret, F.when(between(0, 2, "C") == 0, _pick(leading, "D")).otherwise(_pick(neutral, "E")))
    other = F.when(F.pmod(F.floor(F.col("id") / 2), F.lit(7)).isin(2, 3, 5, 6), _pick(digest, "F")).otherwise(F.when(between(0, 1, "G") == 0, _pick(leading, "H")).otherwise(_pick(neutral, "I")))
    path = F.when(secret, _pick(["", "", "src0", "config/prod.env", "deploy/settings.yml", "app/main.py", "tests/conftest.py"], "J")).otherwise(_pick(["", "", "src1", "tests/fixtures/data.json", "docs/readme.md", "examples/app.py", "config/app.yml", "package-lock.json"], "K"))
    return spark.range(n).select(
        F.when(secret, F.element_at(F.array(*secrets), row)).otherwise(F.element_at(F.array(*others), row)).alias("value"),
        F.when(secret, before).otherwise(other).alias("before"),
        _pick([" and of", "\"", "", " der die", "\n"], "L").alias("after"),
        path.alias("path"),
        secret.cast("int").alias("label"),
    )


@dataclass
class Scanner:
    """A forest and the dictionary that its features were made with."""

    forest: RandomForestClassificationModel
    words: list[str]

    def transform(self, vectors: DataFrame) -> DataFrame:
        return self.forest.transform(vectors)


def _vectors(rows: DataFrame, words: list[str] | None = None) -> DataFrame:
    made = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")), words)
    return VectorAssembler(inputCols=[f"f_{n}" for n in made], outputCol="features").transform(rows.withColumns({f"f_{n}": c for n, c in made.items()})).drop(*(f"f_{n}" for n in made))


def sample(findings: DataFrame, n: int = FINDINGS) -> DataFrame:
    """At most n labelled findings, half of each label, those with the least hash; missing values and labels do not count."""
    rows = findings.where("value IS NOT NULL AND label IN (0, 1)").select("value", "before", "after", "path", F.col("label").cast("int").alias("label"))
    order = F.xxhash64("value", "before", "after", "path")
    halves = []
    for label in (0, 1):
        half = rows.where(F.col("label") == label).orderBy(order, "value", "before", "after", "path").limit(n // 2)
        halves.append(half if not half.isEmpty() else example_findings(findings.sparkSession, n).where(F.col("label") == label))
    return halves[0].unionByName(halves[1])


def train(findings: DataFrame, words: list[str] | None = None) -> Scanner:
    """The forest of a table of labelled findings, of which it reads ``FINDINGS`` rows at most."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    words = sorted({*DICTIONARY, *(words or ())})
    # The forest passes over its rows many times, so they are written once, as one file: one partition, whatever the cluster.
    rows = _vectors(sample(findings), words).select("features", F.col("label").cast("double").alias("label"))
    return Scanner(forest.fit(Scratch(findings.sparkSession, "findings").save(rows.coalesce(1), "vectors")), words)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> Scanner:
    """A forest from the documents' own candidates, labelled by weak rules, and from the examples; its dictionary holds the documents' words."""
    words = corpus_words(docs, text=text)
    scratch = Scratch(docs.sparkSession, "weak-findings")
    own = scratch.save(weak_findings(docs, sorted({*DICTIONARY, *words}), key, text, path), "findings")
    return train(example_findings(docs.sparkSession).unionByName(own), words)


def _scored(docs: DataFrame, model: Scanner, key: str, text: str, path: str | None) -> DataFrame:
    scored = model.transform(_vectors(candidates(docs, key, text, path), model.words))
    probability = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "mark", "kind", "value", "position", "occurrences", F.round(probability, 6).alias("score"), (probability >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, model: Scanner, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``(doc_id, kind, value, position, occurrences, score, is_secret)``, a row for each candidate."""
    return _scored(docs, model, key, text, path).drop("mark")


def redact(docs: DataFrame, model: Scanner, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """All documents in all their columns; each secret in a text is replaced by its kind.

    Longer values are replaced first. ``n_chars``, where there is one, follows the text. The
    secrets are found and written first, by id and text, so that rows without an id do not
    share theirs; texts are shuffled to them only where they hold more than ``BROADCAST_BYTES``.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = _scored(docs, model, key, text, path).where("is_secret").select(F.col("doc_id").alias("\0key"), F.col("mark").alias("\0mark"), F.struct(F.char_length("value").alias("n"), "value", "kind").alias("s"))
    listed = scratch.save(found.groupBy("\0key", "\0mark").agg(F.sort_array(F.collect_set("s"), asc=False).alias("\0secrets")), "found")
    held = listed.agg(F.sum(F.aggregate("\0secrets", F.lit(0).cast("long"), lambda n, x: n + x["n"] + 96)).alias("n")).first()["n"] or 0
    if held <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    joined = docs.join(listed, F.col(key).eqNullSafe(F.col("\0key")) & (_mark(F.col(text)) == F.col("\0mark")), "left")
    clean = F.aggregate(F.col("\0secrets"), F.col(text), lambda t, s: F.replace(t, s["value"], F.concat(F.lit("[secret:"), s["kind"], F.lit("]"))))
    has = F.col("\0secrets").isNotNull()
    changed = {text: F.when(has, clean).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(has, F.char_length(clean).cast(kind)).otherwise(F.col("n_chars"))
    return joined.withColumns(changed).select(*(F.col(c) for c in docs.columns))

"""Secret scan: patterns propose findings, a random forest removes the false ones, all inside SQL expressions.

Findings are long runs of key-like characters that hold a digit or begin like a known kind of key, and values assigned
to a name that announces a credential. The
forest sees a finding's length, its runs of character classes and consonant-vowel transitions, how much of it common
words cover, whether it stands in a path, and the words around it. It is trained with Spark ML on labelled findings of
fourteen kinds, made from row numbers by SQL functions (bounded by ``n`` of ``labelled_findings``), and then compiled
into CASE expressions, so scanning needs neither Python workers nor a shuffle and whole texts are read once.

Defined cases: null and empty texts have no findings; rows that repeat are scanned each; a text may hold any number of
findings; an empty table gives an empty result; other columns are carried along by ``redact``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

# Names that announce a credential, names that announce something else, and common parts of identifiers.
SECRET_WORDS = "token|secret|passwd|password|pwd|api[_ -]?key|apikey|auth|credential|bearer|private|access[_ -]?key|client"
OTHER_WORDS = "commit|sha-?\\d*|md5|checksum|hash|digest|uuid|guid|version|revision|isbn|order|invoice|phone|tel|card|iban|file|image|img|http|www|build|serial|model|page|date|time|id"
COMMON_PARTS = (
    "example|sample|test|demo|dummy|placeholder|your|here|change|insert|data|file|image|user|name|version|report|final|draft|"
    "index|page|photo|video|audio|config|setting|default|service|server|client|event|order|item|product|build|release|"
    "android|windows|linux|python|java|http|html|json|abcdef|qwerty|xxxx|0000|1234|chapter|section|table|figure|part|"
    "model|type|class|module|package|update|backup|copy|export|import|the|and|ing|tion|ment|able|for|with"
)
KNOWN_PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[bp]-|sk-|sk_live_|pk_live_|AIza|eyJ"
NAME_END = "(?:[_ -]?(?:key|keys|id|ids|token|tokens|secret|secrets))?"
FINDING = (
    rf"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9]|{KNOWN_PREFIXES})[A-Za-z0-9_+/-]{{16,}}={{0,2}}"
    rf"|(?<=[\s:=\"'])(?<=(?i:(?:{SECRET_WORDS})s?{NAME_END}{NAME_END})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)[^\s\"']{{8,}}"
)
BEFORE, AFTER = 48, 24
TREES, DEPTH, THRESHOLD = 24, 6, 0.5


def feature_columns(text: Column, before: Column, after: Column) -> list[tuple[str, Column]]:
    """Features of a finding from its text and its neighbourhood; all finite doubles."""
    n = F.length(text)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "-")
    low = F.lower(text)

    def share(pattern: str, of: Column = text) -> Column:
        return (n - F.length(F.regexp_replace(of, pattern, ""))) / n

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    return [
        ("length", n.cast("double")),
        ("class_runs", F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) / n),
        ("digits", share("[0-9]")),
        ("upper", share("[A-Z]")),
        ("hex", share("[0-9a-fA-F]")),
        ("symbols", share("[^0-9A-Za-z]")),
        ("consonant_vowel", share("[bcdfghjklmnpqrstvwxz][aeiou]", low)),
        ("dictionary", share(COMMON_PARTS, low)),
        ("distinct", F.size(F.array_distinct(F.split(text, ""))) / n),
        ("repeats", share(r"(.)\1\1+", low)),
        ("path", flag(text.rlike(r"/[a-z]+/|\w+/\w+/") | before.rlike(r"[/\\.@]$") | after.rlike(r"^[/\\@]|^\.[a-z]{2,4}\b"))),
        ("uuid", flag(text.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))),
        ("assigned", flag(before.rlike(r"[:=]\s{0,2}[\"']?$"))),
        ("quoted", flag(before.rlike("[\"'`]$"))),
        ("secret_words", flag(before.rlike(f"(?i)({SECRET_WORDS})"))),
        ("other_words", flag(before.rlike(f"(?i)\\b({OTHER_WORDS})\\b"))),
        ("known_prefix", flag(text.rlike(f"^({KNOWN_PREFIXES})"))),
    ]


def labelled_findings(spark: SparkSession, n: int = 4200) -> DataFrame:
    """n labelled findings (text, before, after, label) of fourteen kinds, from row numbers alone."""
    def pick(seed: int, *choices: str) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(choices))) + 1).cast("int"))

    def digest(seed: int) -> Column:
        return F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(seed)), 512)

    def part(c: Column, at: int, size: int) -> Column:
        return F.substring(c, at, size)

    d, e = digest(1), digest(2)
    mixed = F.regexp_replace(F.base64(F.unhex(d)), "[\r\n=]", "")
    number = F.concat(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**9)).cast("string") for k in (3, 4, 5)])
    name = pick(6, "token", "secret", "api_key", "apikey", "password", "access_key", "client_secret", "auth token", "TOKEN", "SECRET_KEY")
    assign = F.concat(pick(7, "", "the of and ", "set ", "export ", "in this "), name, pick(8, " = \"", "=", ": ", ": \"", "='"))
    prose = pick(9, "was the and ", "See also ", "of the ", "", "der die das ", "que la ")
    words = [pick(k, "report", "final", "photo", "user", "data", "version", "image", "chapter", "event", "config", "backup", "release") for k in (10, 11, 12)]
    size = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(24)).cast("int")
    kinds = [
        # text, before, label
        (part(d, 1, 40), assign, 1),
        (F.substring(d, F.lit(1), size + 24), assign, 1),
        (F.substring(mixed, F.lit(1), size + 20), assign, 1),
        (F.upper(part(d, 1, 40)), assign, 1),
        (F.concat(pick(14, "ghp_", "sk-", "AKIA", "xoxb-", "glpat-", "sk_live_"), F.substring(mixed, F.lit(1), size + 16)), F.concat(prose, pick(15, "", "key ", "\"")), 1),
        (F.concat(pick(16, "Hunter", "pAss", "Winter", "qW3r"), part(mixed, 1, 6), pick(17, "!", "#9", "$1", "42")), assign, 1),
        (F.concat_ws("-", part(d, 1, 8), part(d, 9, 4), part(d, 13, 4), part(d, 17, 4), part(d, 21, 12)), F.concat(prose, pick(18, "id ", "uuid=", "guid: ", "")), 0),
        (F.substring(number, F.lit(1), F.lit(16)), F.concat(prose, pick(19, "card ", "order ", "tel ", "", "invoice ")), 0),
        (part(d, 1, 40), F.concat(prose, pick(20, "commit ", "revision ", "sha1 ", "checksum: ", "Merge commit ")), 0),
        (part(e, 1, 64), F.concat(prose, pick(21, "sha256 ", "digest: ", "hash of file ", "sha256:")), 0),
        (F.concat_ws("/", words[0], words[1], F.concat(words[2], part(number, 1, 4))), F.concat(prose, pick(22, "/", "./", "http://", "see ")), 0),
        (F.concat_ws("_", words[0], words[1], words[2], part(number, 1, 2)), F.concat(prose, pick(23, "file ", "", "image ", "key of ")), 0),
        (pick(24, "your_api_key_here_123", "xxxxxxxxxxxxxxxx1234", "example-token-00000000", "insert-your-token-1", "changeme12345678", "test_secret_key_1234", "1234567890123456", "placeholder-000001"), assign, 0),
        (F.concat(words[0], words[1], part(number, 1, 6), words[2]), F.concat(prose, pick(25, "", "model ", "version ")), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    chosen = reduce(
        lambda rest, k: F.when(kind == k, F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(a) for a, c in zip(("text", "before", "label"), kinds[k], strict=True)])).otherwise(rest),
        range(len(kinds)), F.lit(None),
    )
    after = pick(26, "\" the and", " was", ".", "\n", ", of", "' in")
    return spark.range(n, numPartitions=1).select(chosen.alias("c"), after.alias("after")).select("c.text", "c.before", "after", "c.label")


def fit_forest(findings: DataFrame, seed: int = 5) -> list[list]:
    """Trees of a random forest as nested lists: [feature, split, left, right] or a vote of 0 or 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    named = feature_columns(F.col("text"), F.col("before"), F.col("after"))
    rows = findings.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in named])
    vectors = VectorAssembler(inputCols=[n for n, _ in named], outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return parse_forest(forest.toDebugString)


def parse_forest(text: str) -> list[list]:
    lines = [line.strip() for line in text.splitlines()]

    def node() -> list | int:
        line = lines.pop(0)
        if leaf := re.match(r"Predict: ([\d.]+)", line):
            return int(float(leaf[1]))
        feature, split = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        lines.pop(0)  # Else
        return [int(feature), float(split), left, node()]

    trees = []
    while lines:
        if lines.pop(0).startswith("Tree "):
            trees.append(node())
    return trees


def vote_share(trees: list[list], features: Column, names: list[str]) -> Column:
    def of(tree: list | int) -> Column:
        if isinstance(tree, int):
            return F.lit(tree)
        return F.when(features[names[tree[0]]] <= F.lit(tree[1]), of(tree[2])).otherwise(of(tree[3]))

    return reduce(lambda a, b: a + b, [of(t) for t in trees]) / len(trees)


def with_findings(docs: DataFrame, trees: list[list]) -> tuple[DataFrame, str, str]:
    """docs with two more columns and their names: the text around findings, and an array of start, finding, score in text order."""
    raw, between, described, found = free_name(docs, "raw", "between", "described", "found")
    pairs = F.transform(
        raw,
        lambda finding, i: F.struct(
            finding.alias("finding"),
            F.right(F.get(between, i), F.lit(BEFORE)).alias("before"),
            F.left(F.get(between, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    names = [n for n, _ in feature_columns(F.lit(""), F.lit(""), F.lit(""))]
    features = F.transform(
        pairs,
        lambda p: F.struct(p["finding"].alias("finding"), F.struct(*[c.cast("double").alias(n) for n, c in feature_columns(p["finding"], p["before"], p["after"])]).alias("f")),
    )
    lengths = F.transform(raw, lambda x, i: F.length(F.get(between, i)) + F.length(x))
    starts = F.transform(raw, lambda x, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, b: a + b) - F.length(x))
    rows = (
        docs.withColumn(raw, F.regexp_extract_all("text", F.lit(FINDING), F.lit(0)))
        .withColumn(between, F.when(F.size(raw) > 0, F.split("text", FINDING)))
        .withColumn(described, F.when(F.size(raw) > 0, features))
        .withColumn(
            found,
            F.transform(
                described,
                lambda p, i: F.struct(F.get(starts, i).cast("long").alias("start"), p["finding"].alias("finding"), vote_share(trees, p["f"], names).alias("score")),
            ),
        )
        .drop(raw, described)
    )
    return rows, between, found


def scan(docs: DataFrame, trees: list[list] | None = None) -> DataFrame:
    """One row per finding: the columns of docs but text and those named like a result, start (character, from 0), finding, score, secret."""
    trees = trees or fit_forest(labelled_findings(docs.sparkSession))
    rest = [f"`{c}`" for c in docs.columns if c not in ("text", "start", "finding", "score", "secret")]
    rows, _, found = with_findings(docs, trees)
    [one] = free_name(rows, "one")
    return (
        rows.select(*rest, F.explode(found).alias(one))
        .select(*rest, f"{one}.start", f"{one}.finding", f"{one}.score", (F.col(f"{one}.score") >= THRESHOLD).alias("secret"))
    )


def redact(docs: DataFrame, mark: str = "[secret]", trees: list[list] | None = None) -> DataFrame:
    """docs with every finding judged a secret replaced by mark."""
    trees = trees or fit_forest(labelled_findings(docs.sparkSession))
    rows, between, found = with_findings(docs, trees)
    pieces = F.transform(found, lambda f, i: F.concat(F.get(between, i), F.when(f["score"] >= THRESHOLD, F.lit(mark)).otherwise(f["finding"])))
    clean = F.concat(F.array_join(pieces, ""), F.element_at(between, -1))
    return rows.withColumn("text", F.when(F.col(between).isNull(), F.col("text")).otherwise(clean)).drop(between, found)


def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", F.length("finding").alias("length"), F.sha2("finding", 256).alias("finding_sha256"), "score", "secret")

"""Secret scan: patterns find candidates, and a random forest trained on labelled findings removes the false ones.

The forest sees a candidate's length, its changes of character class, its digits and different characters, how much of it dictionary
words cover, whether a path leads to it, and the words before it. The dictionary is the words of a public vocabulary (a path), some 20,000, and a few that run together. Everything is DataFrame operations and Spark ML's trees.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import public_tokenizers
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import told_spans

#: Labelled findings that the forest is trained on, where none are given.
LABELLED = 4_000
TREES, DEPTH, SEED = 24, 7, 7

# Names that secrets are assigned to, public key formats, and words that make a value no secret.
_NAMES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?key"
_FORMATS = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[baprs]-[A-Za-z0-9-]{10,}|\bsk_live_[A-Za-z0-9]{16,}|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|(?<=[Bb]earer\x20)[A-Za-z0-9._~+/-]{16,}={0,2}|(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]{8,64}(?=@)"
_SIGN = r"[\"']?[\x20\t]*+(?::=|=>|={1,2}|:)[\x20\t]*+"
_VALUE = r"(?:\"[^\"\r\n]{8,}+\"|'[^'\r\n]{8,}+'|[\"']?[^\s\"'`,;<>(){}\[\]]{7,}[^\s\"'`,;<>(){}\[\].:?][\"']?)"
# a whole run of word characters that holds a name; that a sign and a value come after the run is asked first, once a run, for linear time
_NAMED = rf"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++{_SIGN}{_VALUE})(?i:[A-Za-z0-9_.-]*?(?:{_NAMES})[A-Za-z0-9_.-]*+){_SIGN}"
_ASSIGNED = f"{_NAMED}{_VALUE}"
_RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}={0,2}"
CANDIDATE = f"{_ASSIGNED}|{_FORMATS}|{_RANDOM}"
_DICTIONARY = (
    "access account admin alpha apple auth beta cache change changeme client code config data database default demo dummy email enter example field file form foobar "
    "function hello here hidden host input insert item label local login master name none null number object option output param pass password path placeholder please "
    "private production public query replace required reset root sample secret secure select server service session setting some staging string super system table "
    "template test text their token type undefined update user username value variable welcome with word world xxxx your"
).split()
_FALSE_WORDS = "example|sample|placeholder|dummy|fake|test|commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|etag|revision|build"

FEATURES = ("length", "transitions", "digits", "different", "dictionary", "assigned", "known_format", "path", "secret_word", "false_word")


@lru_cache(maxsize=2)
def dictionary(vocabulary: str) -> tuple[str, ...]:
    """The words of four lower-case letters or more that the vocabulary file (tokens in base64 and their ranks) has with a space before them."""
    with open(vocabulary, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return tuple(sorted({t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t)}))


def candidates(docs: DataFrame, *keep: str, vocabulary: str | None = None) -> DataFrame:
    """start, end (code points), value, and FEATURES of each candidate of docs (text, source), with the columns keep of docs."""
    text = F.coalesce(docs.text.cast("string"), F.lit(""))
    found = docs.select(*[docs[k] for k in keep], F.coalesce(docs.source.cast("string"), F.lit("")).alias("__tw_source"), F.explode(told_spans(text, CANDIDATE)).alias("__tw"))
    assigned = F.regexp_extract("__tw.raw", rf"^{_NAMED}[\"']?(.{{8,}}?)[\"']?$", 1)
    value = F.when(assigned != "", assigned).otherwise(F.col("__tw.raw"))
    rows = found.select(*keep, F.col("__tw.start").alias("start"), F.col("__tw.end").alias("end"), value.alias("value"), F.col("__tw.raw").alias("__tw_raw"), F.lower("__tw.before").alias("__tw_before"), F.lower("__tw_source").alias("__tw_source"))
    return _features(rows, dictionary(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))


def _covered(words: tuple[str, ...]) -> Column:
    """How many characters of value are runs of letters that are words."""
    known = ", ".join(f"'{w}'" for w in words)
    return F.expr(f"aggregate(regexp_extract_all(value, '[A-Z]?[a-z]+|[A-Z]+', 0), 0, (n, w) -> n + if(lower(w) in ({known}), length(w), 0))")


def _features(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    around = F.concat_ws(" ", "__tw_before", F.lower("__tw_raw"))
    like = lambda c, r: F.regexp_like(c, F.lit(r)).cast("double")
    columns: dict[str, Column] = {
        "length": F.length(v).cast("double"),
        "transitions": F.regexp_count(v, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")) / size,
        "digits": F.length(F.regexp_replace(v, "[^0-9]", "")) / size,
        "different": F.size(F.array_distinct(F.split(v, ""))) / size,
        "dictionary": F.greatest(1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(_DICTIONARY, key=len, reverse=True)), "")) / size, _covered(words) / size),
        "assigned": like(F.col("__tw_raw"), f"^{_ASSIGNED}$"),
        "known_format": F.greatest(like(v, f"^(?:{_FORMATS})$"), like(F.concat("__tw_before", "__tw_raw"), f"(?:{_FORMATS})$")),
        "path": F.greatest(like(F.col("__tw_before"), r"/[^\s]*$"), like(F.col("__tw_source"), r"(?:^|[/_.-])(?:tests?|examples?|docs?|fixtures?|samples?)(?:$|[/_.-])")),
        "secret_word": like(around, rf"(?:{_NAMES}|credential|bearer|aws)"),
        "false_word": like(around, rf"(?:{_FALSE_WORDS})"),
    }
    return rows.select(*[c for c in rows.columns if not c.startswith("__tw_")], *[c.alias(k) for k, c in columns.items()])


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """text, source and is_secret (0 or 1): n findings as a review labels them, half of them false; made by rule, the same each time."""
    made = spark.range(n).select(
        F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))).alias("b64"),
        F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 256))), "[^A-Za-z2-7]", "Q")).alias("upper"),
    )
    word = lambda k: F.element_at(F.array(*map(F.lit, _DICTIONARY)), (F.xxhash64(F.lit(k), "id") % len(_DICTIONARY) + len(_DICTIONARY)).cast("int") % len(_DICTIONARY) + 1)
    alnum = F.regexp_replace("b64", "[^A-Za-z0-9]", "x")
    long, short = F.left("hex", F.lit(40)), F.substring("hex", F.lit(3), 16 + F.col("id") % 9)
    mixed = F.left(alnum, 9 + F.col("id").cast("int") % 8)
    signed = F.translate(F.left(F.col("b64"), 11 + F.col("id").cast("int") % 8), "aeiouAE+/", "@!#$%&*^?")
    true = [
        F.concat(F.lit("set password="), short, F.lit(" on it")),
        F.concat(F.lit('the token = "'), long, F.lit('" is')),
        F.concat(F.lit("key AKIA"), F.left("upper", F.lit(16)), F.lit(" of")),
        F.concat(F.lit("use ghp_"), F.left(alnum, F.lit(36)), F.lit(" now")),
        F.concat(F.lit("api_key: "), F.left(alnum, 20 + F.col("id").cast("int") % 20), F.lit(" x")),
        F.concat(F.lit("client_secret='"), F.left("b64", F.lit(32)), F.lit("'")),
        F.concat(F.lit("and then AKIA"), F.substring("upper", F.lit(5), F.lit(16)), F.lit(" a b")),
        F.concat(F.lit("send aws credential "), F.left("b64", F.lit(40)), F.lit(" ok")),
        F.concat(F.lit("export DB_PASSWORD="), mixed, F.lit(" then")),
        F.concat(F.lit("db_password: '"), mixed, F.lit("' for")),
        F.concat(F.lit("GITHUB_TOKEN="), F.left("hex", 12 + F.col("id").cast("int") % 20), F.lit(" in")),
        F.concat(F.lit('SECRET_KEY  =  "'), signed, F.lit('" set')),
        F.concat(F.lit("my password: "), signed, F.lit(" is")),
        F.concat(F.lit("api_key_prod = "), F.left(alnum, F.lit(20)), F.lit(" go")),
        F.concat(F.lit("Authorization: Bearer "), F.left(F.concat(alnum, F.reverse(alnum)), 20 + F.col("id").cast("int") % 61), F.lit(" and")),
        F.concat(F.lit("at postgres://"), word("a"), F.lit(":"), mixed, F.lit("@db.internal/main")),
        F.concat(F.lit('{"accessKey": "'), F.left("b64", F.lit(40)), F.lit('"}')),
        F.concat(F.lit("passwd "), mixed, F.lit(" or pwd="), mixed),
    ]
    false = [
        F.concat(F.lit("set password="), word("a"), word("b"), F.lit("123 on it")),
        F.concat(F.lit('the token = "'), word("a"), F.lit("_"), word("b"), F.lit("_"), word("c"), F.lit('"')),
        F.concat(F.lit("as in commit "), long, F.lit(" we")),
        F.concat(F.lit("file sha256 "), F.col("hex"), F.lit(" is")),
        F.concat(F.lit("see /static/img/"), F.left("hex", F.lit(32)), F.lit(".png")),
        F.concat(F.lit("uuid "), F.left("hex", F.lit(8)), F.lit("-"), F.substring("hex", 9, 4), F.lit("-"), F.substring("hex", 13, 4), F.lit("-"), F.substring("hex", 17, 12)),
        F.concat(F.lit("api_key: your_"), word("a"), F.lit("_"), word("b"), F.lit("_here")),
        F.concat(F.lit("example key AKIA"), F.rpad(F.upper(word("a")), 9, "X"), F.lit("EXAMPLE")),
        F.concat(F.lit("export DB_PASSWORD="), word("a"), F.lit("_"), word("b"), F.lit("_1 then")),
        F.concat(F.lit("db_password: '"), word("a"), F.lit(" "), word("b"), F.lit(" "), word("c"), F.lit("' for")),
        F.concat(F.lit("GITHUB_TOKEN=${"), F.upper(word("a")), F.lit("_TOKEN_"), word("b"), F.lit("} in")),
        F.concat(F.lit('SECRET_KEY  =  "<'), word("a"), F.lit("-"), word("b"), F.lit('>" set')),
        F.concat(F.lit("my password: "), word("a"), F.lit("."), word("b"), F.lit("."), word("c"), F.lit(" is")),
        F.concat(F.lit("api_key_prod = "), word("a"), F.lit("."), word("b"), F.lit("_"), word("c"), F.lit(" go")),
        F.concat(F.lit("src=data:image/png;base64,"), F.col("b64"), F.col("b64"), F.col("b64"), F.lit(" end")),
        F.concat(F.lit('integrity="sha512-'), F.col("b64"), F.lit('" on')),
        F.concat(F.lit("call "), word("a"), F.initcap(word("b")), F.initcap(word("c")), F.initcap(word("d")), F.lit("Impl2Factory3Bean it")),
        F.concat(F.lit("password: ********"), F.lit(" and token=********")),
        F.concat(F.lit("page /"), word("a"), F.lit("/"), word("b"), F.lit("-"), word("c"), F.lit("-2024-01-"), (F.col("id") % 28 + 1).cast("string"), F.lit("/"), F.left("hex", F.lit(12)), F.lit(" is")),
        F.concat(F.lit("request "), F.left("hex", F.lit(8)), F.lit("-"), F.substring("hex", 9, 4), F.lit("-4"), F.substring("hex", 13, 3), F.lit("-"), F.substring("hex", 17, 4), F.lit("-"), F.substring("hex", 21, 12), F.lit(" from")),
        F.concat(F.lit('etag: "'), F.left("hex", F.lit(32)), F.lit('" set')),
    ]
    pick = lambda texts: F.element_at(F.array(*texts), (F.shiftright("id", 1) % len(texts) + 1).cast("int"))
    good = F.col("id") % 2
    source = F.when((good == 0) & (F.col("id") % 6 == 0), "docs/example").otherwise(F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    return made.select(F.when(good == 1, pick(true)).otherwise(pick(false)).alias("text"), source.alias("source"), good.cast("double").alias("is_secret"))


def train(findings: DataFrame, vocabulary: str | None = None) -> RandomForestClassificationModel:
    """The forest for findings (text, source, is_secret); bounded by the caller, who hands over a table of LABELLED rows by default."""
    rows = _assembled(candidates(findings, "is_secret", vocabulary=vocabulary))
    return RandomForestClassifier(featuresCol="__tw_features", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__tw_features").transform(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, end, value_sha256, score and is_secret: a row for each candidate of each row of docs (doc_id, text, source).

    start and end are code points of the candidate, end exclusive. score is the forest's probability of a secret, is_secret whether it is over a half; at just a half it isn't.
    Null and empty texts have no candidates, a null source says nothing. Rows that repeat are scanned each; other columns of docs are not read.
    """
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession), vocabulary)
    judged = model.transform(_assembled(candidates(docs, "doc_id", vocabulary=vocabulary)))
    score = F.round(vector_to_array("probability")[1], 6)
    return judged.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (F.col("prediction") > 0.5).alias("is_secret"))

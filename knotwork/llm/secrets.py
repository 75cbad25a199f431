"""Credentials in text, told apart by how many owners and repositories of the corpus hold the same one.

Scale: candidates are found by JVM expressions in one scan; from then on only their SHA-256 hashes, owners and places
travel. Owners and repositories of a hash are counted by an aggregation with map-side combining over distinct pairs, so a
key that half the corpus copies costs each task one row an owner. The secret itself is never returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.lineage import cut

#: Kind -> pattern whose first group is the secret.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("aws_access_key", r"\b((?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16})\b"),
    ("github_token", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b"),
    ("slack_token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,72})\b"),
    ("google_api_key", r"\b(AIza[0-9A-Za-z_-]{35})\b"),
    ("stripe_key", r"\b([rs]k_(?:live|test)_[0-9A-Za-z]{16,64})\b"),
    ("json_web_token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b"),
    ("private_key", r"(-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?s:.*?)(?:-----END|(?=-----BEGIN)|\z))"),
    (
        "assigned_secret",  # with a name before and after the word, in JSON, and without quotes; with what stands around the value
        r"(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)[A-Za-z0-9_.-]{0,64}(?:\\?[\"'])?[ \t]*(?:=>|:=|[=:])[ \t]*"
        r"((?:\\?[\"'])?[0-9A-Za-z+/=_.-]{16,}[\\\"'(\[]?)",
    ),
)


@dataclass(frozen=True)
class SecretParams:
    """shared_owners: a hash that so many owners or more hold is a widely copied example. min_classes: of digits, lower
    case and upper case, how many a live-looking credential has at least. min_distinct: characters that differ in it."""

    shared_owners: int = 3
    min_classes: int = 2
    min_distinct: int = 8
    repository: str = "source"
    owner: str = "source"


def _key_body(block: Column) -> Column:
    """What tells a private key from others: its body without white space. Without an END line it is what could be base64;
    a header with nothing behind it is all there is."""
    rest = F.regexp_replace(block, r"^-----BEGIN [A-Z0-9 ]+-----", "")
    body = F.when(block.endswith("-----END"), F.regexp_replace(rest, r"-----END$", "")).otherwise(F.regexp_extract(rest, r"^[A-Za-z0-9+/=\\\s]*", 0))
    body = F.regexp_replace(body, r"\\[nrt]|\s", "")
    return F.when(body == "", F.regexp_extract(block, r"^-----BEGIN [A-Z0-9 ]+-----", 0)).otherwise(body)


def _assigned(x: Column) -> Column:
    """The value of an assignment, or null: 16 to 128 characters; not what is called or indexed. A sentence's dots behind it go."""
    body = F.regexp_replace(x, r"^\\?[\"']", "")
    tail = F.regexp_extract(body, r"[\\\"'(\[]$", 0)
    run = F.regexp_replace(body, r"[\\\"'(\[]$", "")
    value = F.when(tail.isin("\\", '"', "'"), run).otherwise(F.regexp_replace(run, r"\.+$", ""))
    fits = ~tail.isin("(", "[") & F.length(value).between(16, 128) & ((body != x) | value.rlike("^[0-9A-Za-z+/_]"))
    return F.when(fits, value)


def _found(text: Column) -> Column:
    clean = {"private_key": _key_body, "assigned_secret": _assigned}

    def of(kind: str, pattern: str) -> Column:
        made = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), clean.get(kind, lambda s: s))
        return F.transform(F.filter(made, lambda s: s.isNotNull()), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret")))

    return F.concat(*(of(kind, pattern) for kind, pattern in PATTERNS))


def candidates(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """(doc_id, repository, owner, kind, hash, length, classes, distinct_chars, occurrences) of each secret of a row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(p.repository).cast("string").alias("repository"),
        F.col(p.owner).cast("string").alias("owner"),
        F.explode(_found(F.col("text").cast("string"))).alias("x"),
    )
    s = F.col("x.secret")
    classes = sum((s.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    return (
        rows.select(
            "doc_id",
            "repository",
            "owner",
            F.col("x.kind").alias("kind"),
            F.sha2(s, 256).alias("hash"),
            F.length(s).alias("length"),
            classes.alias("classes"),
            F.size(F.array_distinct(F.split(s, ""))).alias("distinct_chars"),
        )
        .groupBy("doc_id", "repository", "owner", "kind", "hash", "length", "classes", "distinct_chars")
        .agg(F.count("*").alias("occurrences"))
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners, corpus_occurrences): how widely each hash is held; nulls hold nothing."""
    held = found.groupBy("hash", "repository", "owner").agg(F.sum("occurrences").alias("n"))
    return held.groupBy("hash").agg(
        F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"), F.sum("n").alias("corpus_occurrences")
    )


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """A row for each (document, kind, secret): its hash, how widely it is held, and a verdict.

    verdict: 'shared_example' if ``shared_owners`` owners or more hold it; else 'live_looking' if its characters vary
    enough, or it is a private key; else 'placeholder'. Columns: doc_id, repository, kind, hash, occurrences,
    repositories, owners, corpus_occurrences, verdict. A null owner or repository counts for none; null and empty texts
    hold nothing, an empty table gives no rows; texts are read whole, however long. Rows of one doc_id, repository and owner
    are one document here, their occurrences summed. Other columns are ignored.
    """
    found = cut(candidates(docs, p), "secrets")
    met = found.join(ownership(found), "hash")
    varied = (F.col("classes") >= p.min_classes) & (F.col("distinct_chars") >= p.min_distinct)
    verdict = (
        F.when(F.col("owners") >= p.shared_owners, "shared_example")
        .when(varied | (F.col("kind") == "private_key"), "live_looking")
        .otherwise("placeholder")
    )
    return met.select("doc_id", "repository", "kind", "hash", "occurrences", "repositories", "owners", "corpus_occurrences", verdict.alias("verdict"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_PLAIN = "\nUNION ALL\n".join(
    f"SELECT doc_id, source, '{kind}' AS kind, unnest(regexp_extract_all(text, '{_quoted(pattern)}', 1)) AS s FROM documents" for kind, pattern in PATTERNS[:6]
)
#: Private keys are cut out between one "-----BEGIN" and the next, as RE2 can't look ahead.
ORACLE = rf"""
WITH pieces AS (
  SELECT doc_id, source, '-----BEGIN' || unnest(string_split(text, '-----BEGIN')[2:]) AS piece FROM documents
), keys AS (
  SELECT doc_id, source, regexp_extract(piece, '^-----BEGIN (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY(?: BLOCK)?-----') AS head,
         regexp_extract(piece, '(?s)^-----BEGIN (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY(?: BLOCK)?-----(.*?)(-----END|\z)', ['body', 'stop']) AS m FROM pieces
), bodies AS (
  SELECT doc_id, source, head, regexp_replace(CASE WHEN m.stop = '-----END' THEN m.body ELSE regexp_extract(m.body, '^[A-Za-z0-9+/=\\\s]*') END,
         '\\[nrt]|\s', '', 'g') AS body FROM keys WHERE head <> ''
), assignments AS (
  SELECT doc_id, source, unnest(regexp_extract_all(text, '{_quoted(PATTERNS[7][1])}', 1)) AS x FROM documents
), opened AS (
  SELECT *, regexp_replace(x, '^\\?["'']', '') AS inner_text FROM assignments
), closed AS (
  SELECT *, regexp_extract(inner_text, '[\\"''(\[]$') AS tail, regexp_replace(inner_text, '[\\"''(\[]$', '') AS run FROM opened
), assigned AS (
  SELECT *, CASE WHEN tail IN (chr(92), '"', '''') THEN run ELSE regexp_replace(run, '\.+$', '') END AS s FROM closed
), found AS (
{_PLAIN}
UNION ALL
SELECT doc_id, source, 'private_key', CASE WHEN body = '' THEN head ELSE body END FROM bodies
UNION ALL
SELECT doc_id, source, 'assigned_secret', s FROM assigned
WHERE tail NOT IN ('(', '[') AND length(s) BETWEEN 16 AND 128 AND (inner_text <> x OR regexp_matches(s, '^[0-9A-Za-z+/_]'))
), seen AS (
  SELECT doc_id, source, kind, s, count(*) AS occurrences FROM found GROUP BY doc_id, source, kind, s
), held AS (
  SELECT s, count(DISTINCT source) AS owners, sum(occurrences) AS n FROM seen GROUP BY s
)
SELECT doc_id, source AS repository, kind, sha256(s) AS hash, occurrences, owners AS repositories, owners,
       CAST(n AS BIGINT) AS corpus_occurrences,
       CASE WHEN owners >= 3 THEN 'shared_example'
            WHEN kind = 'private_key'
              OR (CAST(regexp_matches(s, '[0-9]') AS INT) + CAST(regexp_matches(s, '[a-z]') AS INT)
                  + CAST(regexp_matches(s, '[A-Z]') AS INT) >= 2
                  AND len(list_distinct(string_split(s, ''))) >= 8) THEN 'live_looking'
            ELSE 'placeholder' END AS verdict
FROM seen JOIN held USING (s)
"""

"""Secret scans with corpus-wide ownership frequency.

Candidates are strings in the shapes of known credentials and values given to names like token or password. Their
SHA-256 is counted over the whole corpus: in how many distinct repositories and by how many distinct owners it occurs (exact counts). A
string that several owners have is an example that was copied around; one that a single owner has, and
that doesn't look like a placeholder, is that owner's own and looks live.

verdict: 'example' from EXAMPLE_OWNERS owners up; else 'placeholder' if the string says so or has few distinct characters or no digit
(not asked of private keys); else 'live' if one owner has it, 'shared' otherwise.

The repository is the source column; the owner is what comes before its first '/', or all of it. Defined results: null and empty
texts have no candidates; a null source is a repository and owner of its own, ''; rows that repeat give occurrences that repeat but
are counted once; rows with a null doc_id are scanned and redacted as all others, and count together as one document. The secret itself is
never returned. Columns other than those read can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import written

#: An assigned value of at least LEAST_LENGTH characters; a shorter one lacks LEAST_KINDS, so it could only be a placeholder. In quotes it has
#: anything but a line's end, and a quote after a backslash; bare, anything but white space and quotes, less a sentence's or bracket's end.
LEAST_LENGTH = 8
QUOTED = r"(?<=Q)[^Q\\\n]*+(?:\\[^\n][^Q\\\n]*+)*+(?=Q)"
BARE = r"[^ \t\n\f\r\"']*[^ \t\n\f\r\"',;:.)\]}>]"
#: name, words of which the lower-cased text must hold one (a cheap test before the pattern), Java pattern with one group. None has an upper
#: length: a value ends where its characters do, a quoted one at its quote.
PATTERNS = [
    ("aws_key", ("akia", "asia"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github_token", ("ghp_", "gho_", "ghs_", "ghu_", "github_pat_"), r"\b((?:gh[posu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}))"),
    ("slack_token", ("xox",), r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("google_key", ("aiza",), r"\b(AIza[0-9A-Za-z_-]{35,})"),
    ("provider_key", ("sk-", "sk_live", "pk_live", "rk_live"), r"\b((?:sk-[A-Za-z0-9_-]{20,}|[spr]k_live_[A-Za-z0-9]{16,}))"),
    ("jwt", ("eyj",), r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    ("private_key", ("private key",), r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END [A-Z ]*PRIVATE KEY-----)"),
    ("assignment", ("token", "secret", "passw", "pwd", "api", "key", "credential"), r"(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*[\"']?(" + QUOTED.replace("Q", '"') + "|" + QUOTED.replace("Q", "'") + "|" + BARE + ")"),
]
#: The same for RE2, which neither looks behind nor has possessive quantifiers: the value is one of three groups.
SQL_ASSIGNMENT = PATTERNS[-1][2].partition(r"[\"']?(" + QUOTED.replace("Q", '"'))[0] + r"""(?:"([^"\\\n]*(?:\\[^\n][^"\\\n]*)*)"|'([^'\\\n]*(?:\\[^\n][^'\\\n]*)*)'|["']?(""" + BARE + "))"
EXAMPLE_OWNERS = 3
LEAST_KINDS = 8
PLACEHOLDERS = r"(?i)(example|sample|placeholder|changeme|your[_-]?|dummy|redacted|x{6,}|0{8,}|12345678)"
REDACTED = "[REDACTED]"


def _found(text: Column) -> Column:
    """Distinct (kind, secret) of a text."""
    low = F.lower(text)
    each = []
    for kind, hints, pattern in PATTERNS:
        hinted = low.contains(hints[0])
        for h in hints[1:]:
            hinted = hinted | low.contains(h)
        got = F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        if kind == "assignment":
            got = F.filter(got, lambda x: F.length(x) >= LEAST_LENGTH)
        each.append(F.transform(F.array_distinct(got), _named(kind)))
    return F.concat(*each)


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, repo, owner, kind, secret, text_key (128 bits of the text's digest): each distinct candidate of each document."""
    repo = F.coalesce(F.col("source"), F.lit(""))
    d = docs.where("text IS NOT NULL").select("doc_id", repo.alias("repo"), F.element_at(F.split(repo, "/"), 1).alias("owner"), "text", F.explode(_found(F.col("text"))).alias("_f"))
    return d.select("doc_id", "repo", "owner", F.col("_f.kind").alias("kind"), F.col("_f.secret").alias("secret"), _text_key(F.col("text")).alias("text_key"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _verdict(secret: Column, kind: Column) -> Column:
    """Whether a string looks like a placeholder."""
    few = F.size(F.array_distinct(F.split(secret, ""))) < LEAST_KINDS
    return (kind != "private_key") & (secret.rlike(PLACEHOLDERS) | few | ~secret.rlike("[0-9]"))


def scanned(docs: DataFrame) -> DataFrame:
    """candidates(docs) with secret_hash, n_docs, n_repos, n_owners and verdict; it has the secret itself, for redaction."""
    found = candidates(docs).select("*", F.sha2("secret", 256).alias("secret_hash"), _verdict(F.col("secret"), F.col("kind")).alias("_ph"))
    found = written(found, "secrets")
    owned = found.groupBy("kind", "secret_hash").agg(
        (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("bigint"))).alias("n_docs"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners")
    )
    verdict = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("_ph"), "placeholder").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return found.join(owned, ["kind", "secret_hash"]).withColumn("verdict", verdict)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, kind, secret_hash, n_docs, n_repos, n_owners, verdict of each distinct candidate of each document."""
    return scanned(docs).select("doc_id", "kind", "secret_hash", "n_docs", "n_repos", "n_owners", "verdict")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with live and shared secrets replaced by REDACTED in text, and n_chars (if there is one) set to the new length. Rows are known by their text, so a null or repeated doc_id shields none."""
    bad = scanned(docs).where("verdict IN ('live', 'shared')").groupBy(F.col("text_key").alias("_k")).agg(F.collect_set("secret").alias("_secrets"))
    bad = bad.withColumn("_secrets", F.array_sort("_secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)))
    out = docs.withColumn("_k", _text_key(F.col("text"))).join(bad, "_k", "left")
    clean = F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(F.aggregate(F.coalesce("_secrets", F.array().cast("array<string>")), F.col("text"), lambda t, s: F.replace(t, s, F.lit(REDACTED))))
    columns = [clean.alias("text") if c == "text" else F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.length(clean)).cast("bigint").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    hinted = lambda hints: " OR ".join(f"contains(lower(text), '{h}')" for h in hints)
    each = [f"SELECT doc_id, coalesce(source, '') AS repo, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, {quoted(p)}, 1))) AS secret FROM documents WHERE {hinted(hints)}" for kind, hints, p in PATTERNS[:-1]]
    kind, hints, _ = PATTERNS[-1]
    group = lambda i: f"regexp_extract(m, {quoted('^(?:' + SQL_ASSIGNMENT + ')$')}, {i})"
    # of the three groups one holds the value, the others are empty
    value = f"list_transform(regexp_extract_all(text, {quoted(SQL_ASSIGNMENT)}), lambda m: {group(1)} || {group(2)} || {group(3)})"
    each.append(f"SELECT doc_id, coalesce(source, '') AS repo, '{kind}' AS kind, unnest(list_distinct(list_filter({value}, lambda x: length(x) >= {LEAST_LENGTH}))) AS secret FROM documents WHERE {hinted(hints)}")
    return f"""
WITH f AS ({" UNION ALL ".join(each)}),
o AS (SELECT kind, secret, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n_docs, count(DISTINCT repo) AS n_repos, count(DISTINCT string_split(repo, '/')[1]) AS n_owners FROM f GROUP BY kind, secret)
SELECT doc_id, kind, sha256(secret) AS secret_hash, CAST(n_docs AS BIGINT) AS n_docs, n_repos, n_owners,
       CASE WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example'
            WHEN kind <> 'private_key' AND (regexp_matches(secret, '{PLACEHOLDERS}') OR len(list_distinct(string_split(secret, ''))) < {LEAST_KINDS} OR NOT regexp_matches(secret, '[0-9]')) THEN 'placeholder'
            WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS verdict
FROM f JOIN o USING (kind, secret)
"""


ORACLE = _sql()

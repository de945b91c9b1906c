"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.common import stash

#: (rule, expression). Java's and RE2's common ground; no look-around.
FORMATS: tuple[tuple[str, str], ...] = (
    ("aws_access_key", "(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("github_token", "gh[pousr]_[0-9A-Za-z]{36,}"),
    ("gitlab_token", "glpat-[0-9A-Za-z_-]{20,}"),
    ("slack_token", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_api_key", "AIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", "[rs]k_live_[0-9A-Za-z]{16,}"),
    ("json_web_token", "eyJ[0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,}"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\\s]{32,}"),
    ("assignment", "(?i:password|passwd|secret|token|api_?key|access_?key|auth)[\"']? ?[:=]{1,2} ?[\"']?[0-9A-Za-z_+/=.-]{12,}"),
)
#: A secret starts the text or follows something that isn't of a word.
CANDIDATE = "(?:^|[^0-9A-Za-z_])(?:" + "|".join(p for _, p in FORMATS) + ")"
#: An assignment to a longer name that ends in such a word, as DB_PASSWORD; group 1
#: is the value, and no fixed format (CANDIDATE finds these in any case). The SQL
#: doesn't have it.
PREFIXED = "(?:^|[^0-9A-Za-z_])[0-9A-Za-z_]+(?i:password|passwd|secret|token|api_?key|access_?key|auth)[\"']?+ ?+[:=]{1,2}+ ?+[\"']?+(?!" + "|".join(p for n, p in FORMATS if n != "assignment") + ")([0-9A-Za-z_+/=.-]{12,})"
#: Every candidate holds one of these, or one of WORDS in some case: a text without any is not searched.
LITERALS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "AIza", "k_live_", "eyJ", "-----BEGIN")
WORDS = ("passw", "secret", "token", "key", "auth")
#: Words of made-up values; the sequence of digits and letters is one as well.
FAKE = "example|sample|dummy|placeholder|changeme|your|xxxx|000000|1234567|abcdef"
#: A value of fewer distinct characters, or of less entropy (bits a character), is made up.
DISTINCT, ENTROPY = 6, 2.5
#: So many owners make a value an example that is copied around.
WIDELY = 3


def _entropy(v: Column) -> Column:
    """Bits a character, by how often each occurs in the value."""
    n = lambda c: F.length(v) - F.length(F.replace(v, c, F.lit("")))
    return F.log2(F.length(v)) - F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, n(c) * F.log2(n(c))).otherwise(0.0)) / F.length(v)


def _rule(m: Column) -> Column:
    arms = F.lit(None).cast("string")
    for name, p in reversed(FORMATS):
        arms = F.when(m.rlike("^(?:[^0-9A-Za-z_])?(?:" + p + ")"), F.lit(name)).otherwise(arms)
    return arms


def _matches(text: Column) -> Column:
    """What CANDIDATE finds, and the values that PREFIXED does."""
    none = F.lit(None).cast("string")
    plain = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: F.struct(m.alias("m"), none.alias("assigned")))
    longer = F.transform(F.regexp_extract_all(text, F.lit(PREFIXED), F.lit(1)), lambda v: F.struct(none.alias("m"), v.alias("assigned")))
    any_of = lambda t, parts: functools.reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in parts))
    # Assignments need one of the words; the formats one of the literals.
    words = any_of(F.lower(text), WORDS)
    return F.when(words, F.concat(plain, longer)).when(any_of(text, LITERALS), plain)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner: Column | None = None) -> DataFrame:
    """One row per candidate string in a text: id, repository, owner, rule,
    ``secret_hash`` and whether it looks made up. The value itself goes no further."""
    owner = F.split_part(F.col(f"`{repo_col}`").cast("string"), F.lit("/"), F.lit(1)) if owner is None else owner
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{repo_col}`").cast("string").alias("repo"), owner.alias("owner"), F.explode(_matches(F.col(f"`{text_col}`").cast("string"))).alias("c"))
    rows = rows.select("doc_id", "repo", "owner", "c.*")
    rows = rows.withColumn("rule", F.when(F.col("assigned").isNotNull(), "assignment").otherwise(_rule(F.col("m"))))
    # What an assignment assigns, without the name, quotes and the character before.
    bare = F.when(F.col("rule") == "assignment", F.regexp_extract("m", "[0-9A-Za-z_+/.=-]{12,}$", 0)).otherwise(F.regexp_replace("m", "^[^0-9A-Za-z_-]", ""))
    bare = F.regexp_replace(bare, "^(?i:password|passwd|secret|token|api_?key|access_?key|auth)={1,2}", "")
    rows = rows.withColumn("value", F.coalesce("assigned", bare))
    plain = (F.size(F.array_distinct(F.split("value", ""))) < DISTINCT) | (_entropy(F.col("value")) < ENTROPY)
    return rows.select("doc_id", "repo", "owner", "rule", F.sha2("value", 256).alias("secret_hash"), (F.lower("value").rlike(FAKE) | plain).alias("made_up"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner: Column | None = None, widely: int = WIDELY) -> DataFrame:
    """One row per document, rule and candidate hash, with how far the hash
    spreads through the corpus and the verdict that follows:

    ``made_up`` where the value looks like a placeholder (its words, few characters, little
    entropy); ``example`` where at least ``widely`` distinct owners have it; ``shared`` where
    several owners do; ``live`` where it is one owner's, in however many of its
    repositories. Checksums that some formats carry are not looked at.

    A repository is ``repo_col``, its owner the part before the first "/" (or
    the column given). Null repositories count as no repository and no owner,
    so that a hash found only there is ``live`` with counts of 0. Null and
    empty texts hold nothing. Occurrences of a hash in rows of one id are one
    output row with their ``occurrences`` (repeated rows add up; null ids are
    one document). An empty table gives an empty one; other columns are
    ignored. Only candidates are shuffled, once per hash; counts by hash are
    combined before the shuffle, and joined back by hash, where the planner
    broadcasts or splits what is skewed.
    """
    c = candidates(docs, id_col, text_col, repo_col, owner)
    per_doc = c.groupBy("secret_hash", "rule", "made_up", "doc_id", "repo", "owner").agg(F.count("*").alias("k"))
    # Written, so that texts are scanned once for both uses.
    return _verdicts(stash(per_doc, "secrets"), widely)


def _verdicts(per_doc: DataFrame, widely: int) -> DataFrame:
    spread = per_doc.groupBy(F.col("secret_hash").alias("h")).agg(
        F.countDistinct("repo").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.countDistinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("n_documents")
    )
    found = per_doc.groupBy("secret_hash", "rule", "made_up", "doc_id").agg(F.sum("k").alias("occurrences"))
    verdict = F.when(F.col("made_up"), "made_up").when(F.col("n_owners") >= widely, "example").when(F.col("n_owners") > 1, "shared").otherwise("live")
    return found.join(spread, F.col("secret_hash") == F.col("h")).select("doc_id", "rule", "secret_hash", "occurrences", "n_documents", "n_repositories", "n_owners", verdict.alias("verdict"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    arms = " ".join(f"WHEN regexp_matches(m, {q('^(?:[^0-9A-Za-z_])?(?:' + p + ')')}) THEN {q(n)}" for n, p in FORMATS)
    return f"""
WITH c AS (SELECT doc_id, source AS repo, split_part(source, '/', 1) AS owner, unnest(regexp_extract_all(text, {q(CANDIDATE)})) AS m FROM documents),
r AS (SELECT *, CASE {arms} END AS rule FROM c),
v AS (SELECT *, regexp_replace(CASE WHEN rule = 'assignment' THEN regexp_extract(m, '[0-9A-Za-z_+/.=-]{{12,}}$') ELSE regexp_replace(m, '^[^0-9A-Za-z_-]', '') END,
        '^(?i:password|passwd|secret|token|api_?key|access_?key|auth)={{1,2}}', '') AS value FROM r),
w AS (SELECT doc_id, repo, owner, rule, sha256(value) AS secret_hash, regexp_matches(lower(value), {q(FAKE)}) OR len(list_distinct(string_split(value, ''))) < {DISTINCT} OR list_aggregate(string_split(value, ''), 'entropy') < {ENTROPY} AS made_up FROM v),
s AS (SELECT secret_hash AS h, count(DISTINCT repo) AS n_repositories, count(DISTINCT owner) AS n_owners, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS n_documents FROM w GROUP BY 1),
f AS (SELECT doc_id, rule, secret_hash, made_up, count(*) AS occurrences FROM w GROUP BY ALL)
SELECT doc_id, rule, secret_hash, occurrences, n_documents, n_repositories, n_owners,
  CASE WHEN made_up THEN 'made_up' WHEN n_owners >= {WIDELY} THEN 'example' WHEN n_owners > 1 THEN 'shared' ELSE 'live' END AS verdict
FROM f JOIN s ON f.secret_hash = s.h"""

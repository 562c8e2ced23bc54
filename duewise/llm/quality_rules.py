"""Quality rules of documents and of their hosts, in column expressions only.

Each document's text gives counts and rule failures. Failures are added up by host, each host's failure rate
of a rule is shrunk towards the corpus by a beta prior fitted to the hosts themselves, and hosts whose shrunk
rate is above a limit reject their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import Workspace, table
from duewise.llm.registry import query

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: Shrunk failure rate above which a host rejects its documents.
HOST_LIMIT = 0.6


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text; null counts as empty.

    Columns of these names are replaced. Work per text is n log n: windows of words are hashed to 64 bits,
    sorted with their places, and equal neighbours mark the words they cover.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.drop(*names).withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    counted = parts.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    starts = F.when(F.size("_hashes") >= WINDOW, F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1))).otherwise(
        F.array().cast("array<int>")
    )
    windows = counted.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = windows.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    places = F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: F.coalesce(
            (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]),
            F.get("_sorted", i - 1)["h"] == x["h"], F.get("_sorted", i + 1)["h"] == x["h"],
        )),
        lambda x: x["i"],
    ))
    placed = sorted_.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
    # A marked window adds the words up to the next marked one, at most its own.
    added = F.transform("_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(added, F.lit(0).cast("long"), lambda total, x: total + x)
    out = placed.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_places") > 0, covered), F.lit(0).cast("long")))
    return out.drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_places")


def rules(counts: DataFrame) -> dict[str, Column]:
    """Failures of the document rules, by name."""
    return {
        "too_short": F.col("n_words") < MIN_WORDS,
        "too_repetitive": 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"),
    }


def host_rates(failures: DataFrame, host: str, names: list[str]) -> DataFrame:
    """One row per host: documents, and the failures and shrunk failure rate of each rule; no row for a null host.

    The prior of a rule is a beta distribution whose mean is the corpus rate m and whose strength s follows from
    the spread of the host rates (method of moments): s = m (1 - m) / v - 1, with v the variance between hosts
    beyond that of sampling. Without such spread, as with one host, all hosts get the corpus rate (s = 10**6);
    s is at least 1. The shrunk rate is (failures + m s) / (documents + s).
    """
    counted = failures.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("documents"), *(F.sum(F.col(n).cast("long")).alias(n) for n in names)
    )
    totals = counted.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("documents").alias("all"),
        *(F.sum(n).alias(n) for n in names), *(F.sum(F.col(n) * F.col(n) / F.col("documents")).alias(f"{n}_sq") for n in names),
    ).first()
    out = counted
    for n in names:
        mean, strength = _prior(totals["hosts"], totals["all"] or 0, totals[n] or 0, totals[f"{n}_sq"] or 0.0)
        out = out.withColumn(f"{n}_rate", (F.col(n) + F.lit(mean * strength)) / (F.col("documents") + F.lit(strength)))
    return out


def _prior(hosts: int, documents: int, failed: int, squares: float) -> tuple[float, float]:
    if not documents:
        return 0.0, 1.0
    mean = failed / documents
    spread = squares / documents - mean * mean - mean * (1 - mean) * hosts / documents
    if spread <= 0 or mean in (0.0, 1.0):
        return mean, 1e6
    return mean, min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)


def judge_documents(docs: DataFrame, ws: Workspace, limit: float = HOST_LIMIT, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """(verdicts, hosts): counts, base_failed, host_rejected and kept for each row of ``docs``; the host table.

    ``docs`` has doc_id, text and the host column. A document of a null host has the verdict of its own rules.
    Rows that repeat are judged, and counted for their host, one by one. The counts are written once without
    the text; host sums combine before their shuffle, and the join moves only these narrow rows, so that a host
    with a third of all documents is split by adaptive execution.
    """
    counts = with_counts(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text")
    staged = ws.stage(counts.withColumns(rules(counts)), "counts")
    names = list(rules(staged))
    hosts = host_rates(staged, "host", names)
    over = F.greatest(*(F.col(f"{n}_rate") for n in names), F.lit(0.0)) > limit
    rejected = ws.stage(hosts.where(over).select("host", F.lit(True).alias("host_rejected")), "rejected")
    judged = staged.join(rejected, "host", "left").withColumns({
        "base_failed": F.greatest(*(F.col(n) for n in names)),
        "host_rejected": F.coalesce("host_rejected", F.lit(False)),
    })
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")), hosts


def keep_good(docs: DataFrame, ws: Workspace, limit: float = HOST_LIMIT, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that neither their own rules nor their host's verdict reject, with all their columns.

    Texts are counted twice, once for the hosts and once for the rows, so that no text is ever shuffled; the
    rejected hosts meet the rows in an anti join. Rows of a null host are judged by their own rules.
    """
    narrow = with_counts(docs.select(F.col(host).alias("host"), "text")).drop("text")
    names = list(rules(narrow))
    hosts = host_rates(narrow.withColumns(rules(narrow)).select("host", *names), "host", names)
    over = F.greatest(*(F.col(f"{n}_rate") for n in names), F.lit(0.0)) > limit
    rejected = ws.stage(hosts.where(over).select("host"), "rejected")
    own = [c for c in docs.columns if c != "text"]
    # The row number keeps the filter above the counts; below them, it would count a text again for each of its words.
    judged = with_counts(docs.select(F.struct(*own).alias("own"), F.col(host).alias("host"), "text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    good = judged.where((F.col("row") >= 0) & ~F.greatest(*rules(judged).values())).select("own", "host", "text").join(rejected, "host", "left_anti")
    return good.select("own.*", "text").select(*docs.columns)


ORACLE = r"""
with base as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from base where len(w) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from rep) group by doc_id),
lin as (select doc_id, count(*) - count(distinct x) as n from (
  select doc_id, unnest(string_split(t, chr(10))) as x from base) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lin.n, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from base left join cov using (doc_id) left join lin using (doc_id)),
fails as (select *, n_words < 20 as f1, 100 * n_repeat_words > 30 * n_words as f2 from counts),
hosts as (select source, count(*) as n, sum(f1::int) as a, sum(f2::int) as b from fails where source is not null group by source),
tot as (select count(*) as h, sum(n) as n, sum(a) / sum(n) as m1, sum(b) / sum(n) as m2,
    sum(a * a / n) / sum(n) as q1, sum(b * b / n) / sum(n) as q2 from hosts),
var as (select *, q1 - m1 * m1 - m1 * (1 - m1) * h / n as v1, q2 - m2 * m2 - m2 * (1 - m2) * h / n as v2 from tot),
prior as (select *,
    case when v1 <= 0 or m1 in (0, 1) then 1e6 else least(greatest(m1 * (1 - m1) / v1 - 1, 1), 1e6) end as s1,
    case when v2 <= 0 or m2 in (0, 1) then 1e6 else least(greatest(m2 * (1 - m2) / v2 - 1, 1), 1e6) end as s2 from var),
bad as (select source from hosts, prior
  where greatest((hosts.a + m1 * s1) / (hosts.n + s1), (hosts.b + m2 * s2) / (hosts.n + s2)) > 0.6)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed,
  not (f1 or f2) and (source is null or source not in (select source from bad)) as kept
from fails
"""


@query("op2_quality_rules", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    judged, _ = judge_documents(table(spark, sf_dir, "documents"), Workspace(spark, "quality-rules"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *names)

"""Revision history: as-of selection, chains, streaks, retirement, diffs and slowly changing bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import global_rank, running_sum


def active(revisions: DataFrame, include_history: bool = False) -> DataFrame:
    """Current and ambiguous revisions, or all of them."""
    return revisions if include_history else revisions.where(F.col("temporal_status").isin("current", "ambiguous"))


def as_of(revisions: DataFrame, day: str) -> DataFrame:
    """Revisions in force on ``day``, one of each lineage where the history decides it.

    Eligible: dated on or before the day.  A lineage whose dates rise along its supersession
    links gives its latest date; one in which some successor is dated before its predecessor gives the
    eligible revisions that no eligible revision supersedes.  Undated ambiguous revisions always stand.
    Several rows of a lineage in the result mean that the history is ambiguous there.
    """
    undated = revisions.where(F.col("effective_date").isNull() & (F.col("temporal_status") == "ambiguous"))
    eligible = revisions.where(F.col("effective_date") <= F.lit(day).cast("date"))
    before = revisions.select("lineage", F.col("revision").alias("supersedes"), F.col("effective_date").alias("before_date"))
    backdated = revisions.join(before, ["lineage", "supersedes"]).where("before_date > effective_date").select("lineage").distinct()
    gone = eligible.where("supersedes IS NOT NULL").select("lineage", F.col("supersedes").alias("revision"))
    by_link = eligible.join(backdated, "lineage", "left_semi").join(gone, ["lineage", "revision"], "left_anti")
    latest = F.max("effective_date").over(Window.partitionBy("lineage"))
    by_date = eligible.join(backdated, "lineage", "left_anti").withColumn("__latest", latest).where("effective_date = __latest").drop("__latest")
    cols = revisions.columns
    return by_date.select(cols).unionByName(by_link.select(cols)).unionByName(undated.select(cols))


def ambiguous_lineages(selected: DataFrame) -> DataFrame:
    """Lineages that an as-of selection leaves with more than one revision."""
    return selected.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unambiguous(selected: DataFrame) -> DataFrame:
    """The selection, with an error if a lineage has several revisions."""
    n = F.count(F.lit(1)).over(Window.partitionBy("lineage"))
    return selected.withColumn("lineage", F.when(n > 1, F.raise_error(F.concat(F.lit("ambiguous lineage "), F.col("lineage").cast("string"))).cast(selected.schema["lineage"].dataType)).otherwise(F.col("lineage")))


def launch_range(revisions: DataFrame, start: str, end: str, today: str) -> DataFrame:
    """Lineages with exactly one distinct launch date over all revisions, none conflicting, within [start, end]."""
    if end > today:
        raise ValueError("the range must not end in the future")
    if start > end:
        raise ValueError("the range starts after its end")
    got = revisions.groupBy("lineage").agg(F.min("launch_date").alias("a"), F.max("launch_date").alias("b"), F.bool_or(F.col("launch_status") == "conflicting").alias("bad"))
    return got.where((F.col("a") == F.col("b")) & ~F.coalesce("bad", F.lit(False)) & F.col("a").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("lineage", F.col("a").alias("launch_date"))


def launch_rollup(revisions: DataFrame) -> DataFrame:
    """Launch date and status of each lineage from those of its revisions."""
    bad = F.col("launch_status")
    got = revisions.groupBy("lineage").agg(F.min("launch_date").alias("a"), F.max("launch_date").alias("b"), F.bool_or(bad == "conflicting").alias("conflict"), F.bool_or(bad == "invalid").alias("invalid"))
    status = F.when(F.col("conflict") | (F.col("a") < F.col("b")), "conflicting").when(F.col("a").isNotNull(), "confirmed").when(F.col("invalid"), "invalid").otherwise("missing")
    return got.select("lineage", F.when(status == "confirmed", F.col("a")).alias("launch_date"), status.alias("status"))


def chain(observations: DataFrame) -> DataFrame:
    """Revision chain of each lineage: representative per content, its predecessor, and its status.

    (lineage, content, observed, revision): equal contents are one revision, named by its largest id and dated by its first
    observation.  The latest is current, or ambiguous if several share the last date; a predecessor is
    named only where exactly one revision holds the date before.
    """
    one = observations.groupBy("lineage", "content").agg(F.max("revision").alias("revision"), F.min("observed").alias("observed"))
    w = Window.partitionBy("lineage").orderBy("observed")
    step = one.withColumn("step", F.dense_rank().over(w)).withColumn("last", F.max("observed").over(Window.partitionBy("lineage")))
    per = step.groupBy("lineage", "step").agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("r"))
    before = per.select("lineage", (F.col("step") + 1).alias("step"), F.when(F.col("n") == 1, F.col("r")).alias("predecessor"))
    here = per.select("lineage", "step", F.col("n").alias("same_day"))
    got = step.join(here, ["lineage", "step"]).join(before, ["lineage", "step"], "left")
    status = F.when(F.col("observed") < F.col("last"), "superseded").when(F.col("same_day") > 1, "ambiguous").otherwise("current")
    return got.select("lineage", "revision", "observed", "step", F.when(F.col("same_day") == 1, F.col("predecessor")).alias("predecessor"), status.alias("status"))


def bindings(observations: DataFrame) -> DataFrame:
    """One active row per source: each change of content closes the row before and links to it."""
    w = Window.partitionBy("source").orderBy("observed", "revision")
    changed = observations.withColumn("was", F.lag("content").over(w)).where("was IS NULL OR was <> content")
    return changed.select("source", "revision", "content", "observed", F.lead("observed").over(w).alias("superseded_at"), F.lag("revision").over(w).alias("previous_revision"))


def failure_streak(runs: DataFrame, key: str, ok: str, order: list) -> DataFrame:
    """How many newest runs of each key failed before the latest success (all, if none succeeded)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = runs.withColumn("wins", F.sum(F.col(ok).cast("int")).over(w))
    return since.groupBy(key).agg(F.count_if(F.col("wins") == 0).alias("streak"))


def last_success(runs: DataFrame, key: str) -> DataFrame:
    """The latest successful run of each key by finish, else start, time."""
    at = F.coalesce("finished", "started")
    return runs.where("ok").groupBy(key).agg(F.max_by("run", F.struct(at, "run")).alias("run"), F.max(at).alias("at"))


def retirement(absences: DataFrame, grace_runs: int, ratio: float, max_per_run: int, total: int) -> DataFrame:
    """Documents retired now: absent for at least max(2, grace_runs) runs in a row, capped in key order.

    The cap is max(1, min(max_per_run, int(total * ratio))) and counts new judgements only; those beyond it
    keep status 'absent' with their streak.
    """
    cap = max(1, min(max_per_run, int(total * ratio)))
    due = absences.where(F.col("consecutive_absences") >= max(2, grace_runs))
    picked = due.orderBy("issuer", "product_code", "document_id").limit(cap).select("document_id", F.lit("retired").alias("status"))
    return absences.join(picked, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def retention_gate(counts: DataFrame, order: str, ratio: float, minimum: int) -> DataFrame:
    """Each snapshot against the one before: fails below ``minimum`` or ``ratio`` of the previous count."""
    was = F.lag("n").over(Window.orderBy(order))
    low = (F.col("n") < minimum) | F.coalesce(F.col("n") < F.col("was") * ratio, F.lit(False))
    return counts.withColumn("was", was).withColumn("passed", ~low)


def corpus_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Category of every document of two corpora with (document_id, source, product, current)."""
    b = before.select("document_id", F.col("source").alias("source_b"), F.col("product").alias("product_b"), F.col("current").alias("current_b"))
    n = now.select("document_id", F.col("source").alias("source_n"), F.col("product").alias("product_n"))
    sources, products = before.select(F.col("source").alias("source_n")).distinct().withColumn("same_source", F.lit(True)), before.select(F.col("product").alias("product_n")).distinct().withColumn("same_product", F.lit(True))
    both = b.join(n, "document_id", "full_outer").join(sources, "source_n", "left").join(products, "product_n", "left")
    old, new = F.col("source_b").isNotNull(), F.col("source_n").isNotNull()
    category = (
        F.when(old & new, "unchanged").when(new & F.col("same_source"), "byte_revision").when(new & F.col("same_product"), "successor").when(new, "new_product").when(~F.col("current_b"), "historical").otherwise("missing")
    )
    return both.select("document_id", category.alias("category"))


def reconcile(current: DataFrame, legacy: DataFrame, key: list[str], digest: str) -> DataFrame:
    """One row a key from two sources: current wins, legacy fills; several digests within one source block the key.

    outcome: blocked, current, current_conflict (the sources differ), legacy.
    """
    side = lambda d, n: d.groupBy(*key).agg(F.count_distinct(digest).alias(f"{n}_n"), F.min(digest).alias(n))
    both = side(current, "current_digest").join(side(legacy, "legacy_digest"), key, "full_outer")
    blocked = (F.coalesce("current_digest_n", F.lit(0)) > 1) | (F.coalesce("legacy_digest_n", F.lit(0)) > 1)
    outcome = F.when(blocked, "blocked").when(F.col("current_digest").isNull(), "legacy").when(F.col("legacy_digest").isNotNull() & (F.col("legacy_digest") != F.col("current_digest")), "current_conflict").otherwise("current")
    chosen = F.when(outcome == "blocked", F.lit(None)).otherwise(F.coalesce("current_digest", "legacy_digest"))
    return both.select(*key, outcome.alias("outcome"), chosen.alias("digest"))


def remediate(rows: DataFrame) -> DataFrame:
    """Decision for each unresolved revision from flags, first that holds."""
    decision = (
        F.when(F.col("listed") & F.col("has_newer"), "updated_to_latest").when(~F.col("listed") & F.col("has_newer"), "past_excluded").when(F.col("listed") & F.col("acquired"), "provisional_acquired").otherwise("current_error")
    )
    return rows.withColumn("decision", decision)


def carry_forward(new: DataFrame, old: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """New rows, and the old rows of keys whose collection failed."""
    kept = old.join(failed.select(key).distinct(), key, "left_semi")
    return new.join(failed.select(key).distinct(), key, "left_anti").unionByName(kept)


def unreferenced(seen: DataFrame, marked: DataFrame, today: str, grace_days: int = 30) -> DataFrame:
    """Paths no kept generation refers to, for at least ``grace_days`` since first seen so."""
    age = F.datediff(F.lit(today).cast("date"), F.col("first_seen"))
    return seen.join(marked.select("path").distinct(), "path", "left_anti").withColumn("days", age).where(F.col("days") >= grace_days)


def kept_generations(generations: DataFrame, keep: int = 2) -> DataFrame:
    """The newest generations that stay."""
    return generations.orderBy(F.desc("created"), F.desc("generation")).limit(keep)


def refresh_dates(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Next refresh 15 to 30 days after ``day``, spread by hash."""
    from quillon.functions.text import hash_fraction

    return rows.withColumn("refresh", F.date_add(F.lit(day).cast("date"), (F.lit(15) + F.floor(F.lit(15.0) * hash_fraction(F.col(key).cast("string")))).cast("int")))


def recently_used(entries: DataFrame, uses: DataFrame, key: list[str], capacity: int, size: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """A least-recently-used cache: ``entries`` after the ``uses`` (key, used), the ``capacity`` last used ones, and of them as many as fit ``most_bytes``.

    Entries with no use count as used when they were ``stored``; ties stay in key order.  ``last_used`` is added.
    """
    last = uses.groupBy(*key).agg(F.max("used").alias("last"))
    got = entries.join(last, key, "left").withColumn("last_used", F.greatest(F.coalesce("last", "stored"), "stored")).drop("last")
    kept = got.orderBy(F.desc("last_used"), *key).limit(capacity)
    if most_bytes is None:
        return kept
    return running_sum(kept, size, [F.desc("last_used"), *key]).where(F.col("used") <= most_bytes).drop("used")


def pruned(objects: DataFrame, protected: DataFrame, most_bytes: int = 0) -> DataFrame:
    """The objects (path, bytes, last_used) to delete: unprotected ones, least recently used first, until the unprotected rest is at most ``most_bytes``."""
    free = objects.join(protected.select("path").distinct(), "path", "left_anti")
    return running_sum(free, "bytes", [F.desc("last_used"), "path"], "__kept").where(F.col("__kept") > most_bytes).drop("__kept")


def rotation(issuers: DataFrame, days: DataFrame, order: str = "issuer") -> DataFrame:
    """(day, issuer): one issuer a day in turn, in the order of the roster; days count from the first."""
    roster = global_rank(issuers.select(F.col(order).alias("issuer")).distinct(), ["issuer"], "turn")
    turns = global_rank(days.select("day").distinct(), ["day"], "nth").crossJoin(F.broadcast(roster.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return turns.where("n > 0").withColumn("turn", F.pmod(F.col("nth") - 1, F.col("n")) + 1).join(roster, "turn").select("day", "issuer")


def next_turn(pool: DataFrame, ledger: DataFrame, day: str, most_attempts: int = 3) -> DataFrame:
    """(issuer, attempt) to run on ``day``: that day's issuer again while it has attempts left, else the one whose last turn is longest ago.

    ``pool`` has (issuer, place), ``ledger`` (issuer, day, attempt), one row an attempt.  Issuers that had no turn yet come first, by place; a day
    whose attempts are used up gives no row.
    """
    today = F.col("day").cast("date") == F.lit(day).cast("date")
    told = ledger.groupBy("issuer").agg(F.max(F.col("day").cast("date")).alias("last"), F.count_if(today).alias("tries"))
    roster = pool.select("issuer", "place").join(told, "issuer", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    begun = ledger.where(today).agg((F.count(F.lit(1)) > 0).alias("begun"))
    fits = F.when(F.col("begun"), (F.col("tries") > 0) & (F.col("tries") < most_attempts)).otherwise(True)
    return roster.crossJoin(F.broadcast(begun)).where(fits).orderBy(F.asc_nulls_first("last"), "place").limit(1).select("issuer", (F.col("tries") + 1).alias("attempt"))  # begun: one row

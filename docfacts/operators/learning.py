"""Learning from reviews as event sourcing: effects, support, precision, and the rules' state machine over the ordered log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The policy.
TEMPLATE_SUPPORT, TEMPLATE_PRECISION, CLASS_SUPPORT, CLASS_PRECISION, TYPE_SUPPORT = 2, 1.0, 3, 0.9, 3
SUSPEND_BELOW, LEAST_EVIDENCE, NEGATIVE_STREAK = 0.7, 5, 2
TIME_CHUNKS = 32


def effects(log: DataFrame, *carried: str) -> DataFrame:
    """rule_id, document_key, effect, at, seq (and the rule's `carried` columns): one effect per rule and document. A negative one overrides, never the reverse; its time is that of the first event with it."""
    moment = F.struct("at", "seq")
    denied, first = F.min(F.when(F.col("effect") == "NEGATIVE", moment)), F.min(moment)
    out = log.groupBy("rule_id", "document_key").agg(denied.alias("denied"), F.coalesce(denied, first).alias("m"), *[F.first(c).alias(c) for c in carried])
    return out.select("rule_id", "document_key", F.when(F.col("denied").isNotNull(), "NEGATIVE").otherwise("POSITIVE").alias("effect"), "m.at", "m.seq", *carried)


def counts(effect_rows: DataFrame) -> DataFrame:
    """Per rule: support, negatives, precision (null without proofs) and reliability."""
    p, n = F.col("support"), F.col("negatives")
    out = effect_rows.groupBy("rule_id").agg(F.count_if(F.col("effect") == "POSITIVE").alias("support"), F.count_if(F.col("effect") == "NEGATIVE").alias("negatives"))
    return out.withColumn("precision", p / (p + n)).withColumn("reliability", (p + 1) / (p + n + 2))


def promotes(kind: Column, scope: Column, support: Column, negatives: Column) -> Column:
    """Whether a candidate with these counts becomes active."""
    template = F.coalesce(scope == "TEMPLATE", F.lit(False))
    enough = support >= F.when(template, TEMPLATE_SUPPORT).otherwise(CLASS_SUPPORT)
    precise = support / (support + negatives) >= F.when(template, TEMPLATE_PRECISION).otherwise(CLASS_PRECISION)
    return F.when(F.coalesce(kind == "TEMPLATE_TYPE", F.lit(False)), (support >= TYPE_SUPPORT) & (negatives == 0)).otherwise(enough & F.coalesce(precise, F.lit(False)))


def suspends(kind: Column, since: Column, confirmed: Column, denied: Column, streak: Column) -> Column:
    """Whether an active rule is suspended, by its effects since activation; streak: whether the last NEGATIVE_STREAK of them are all negative."""
    imprecise = (since >= LEAST_EVIDENCE) & (confirmed / since < SUSPEND_BELOW)
    return F.when(F.coalesce(kind == "TEMPLATE_TYPE", F.lit(False)), denied > 0).otherwise(F.coalesce(streak, F.lit(False)) | F.coalesce(imprecise, F.lit(False)))


def time_chunks(proofs: DataFrame, chunks: int) -> Column:
    """Number of the stretch of time that `at` falls into; stretches hold about as many proofs each. Nulls come last."""
    cuts = proofs.agg(F.percentile_approx("at", [i / chunks for i in range(chunks)]).cast("array<string>")).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{dict(proofs.dtypes)['at']}>")
    return F.when(F.col("at").isNull(), chunks).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("at"))))


def rule_states(proofs: DataFrame, chunks: int = TIME_CHUNKS) -> DataFrame:
    """rule_id, status, positive, negative, changes after all proofs of each rule, in order of (at, seq).

    proofs: rule_id, kind, scope, effect, at, seq, one a document as `effects` gives them. A candidate is promoted at the first proof at which its counts
    ask for it, and suspended at the first later one at which the proofs since then do; nothing else is automatic. So a rule's proofs
    can be cut by time: each stretch is counted by itself, sums of the earlier stretches (a row each) are added, and a rule with a
    large part of all proofs is spread over as many tasks as stretches.
    """
    rows = proofs.select("rule_id", "kind", "scope", "effect", "at", "seq").withColumn("chunk", time_chunks(proofs, chunks))
    order = [F.col(c).asc_nulls_last() for c in ("at", "seq", "effect")]
    yes, no = F.col("effect") == "POSITIVE", F.col("effect") == "NEGATIVE"
    own, so_far = ["rule_id", "chunk"], Window.partitionBy("rule_id", "chunk").orderBy(*order)
    running = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({"yes": F.count_if(yes).over(running), "no": F.count_if(no).over(running), "i": F.row_number().over(so_far), "last": F.lag("effect").over(so_far)})
    stretches = rows.groupBy(*own).agg(F.count_if(yes).alias("p"), F.count_if(no).alias("n"), F.count("*").alias("m"), F.max_by("effect", F.struct(F.col("at").isNull(), "at", F.col("seq").isNull(), "seq", "effect")).alias("closing"))
    by_rule = Window.partitionBy("rule_id").orderBy("chunk")
    before = by_rule.rowsBetween(Window.unboundedPreceding, -1)
    earlier = stretches.select(*own, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "pnm"], F.lag("closing").over(by_rule).alias("closing0"))
    last = F.when(F.col("i") == 1, F.col("closing0")).otherwise(F.col("last"))
    counted = local.join(earlier, own).select(*own, "kind", "scope", "effect", (F.col("p0") + F.col("yes")).alias("p"), (F.col("n0") + F.col("no")).alias("n"), (F.col("m0") + F.col("i")).alias("i"), last.alias("last"))

    ready = promotes(F.col("kind"), F.col("scope"), F.col("p"), F.col("n"))
    first = counted.groupBy(*own).agg(F.min(F.when(ready, F.struct("i", "p", "n"))).alias("ready"))
    active = first.select(*own, F.min("ready").over(Window.partitionBy("rule_id")).alias("active"))
    since = F.col("i") - F.col("active.i")
    streak = (F.col("effect") == "NEGATIVE") & (F.col("last") == "NEGATIVE") & (since >= NEGATIVE_STREAK)
    bad = (since > 0) & suspends(F.col("kind"), since, F.col("p") - F.col("active.p"), F.col("n") - F.col("active.n"), streak)
    ends = counted.join(active, own).groupBy(*own).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"), F.first("active").alias("active"), F.max("p").alias("p"), F.max("n").alias("n"))
    out = ends.groupBy("rule_id").agg(F.bool_or("bad").alias("bad"), F.bool_or(F.col("active").isNotNull()).alias("active"), F.max("p").cast("int").alias("positive"), F.max("n").cast("int").alias("negative"))
    status = F.when(F.col("bad"), "SUSPENDED").when(F.col("active"), "ACTIVE").otherwise("CANDIDATE")
    return out.select("rule_id", status.alias("status"), "positive", "negative", (F.col("active").cast("int") + F.col("bad").cast("int")).alias("changes"))


def settle(rules: DataFrame, effect_rows: DataFrame, touched: DataFrame) -> DataFrame:
    """rule_id, before, after, action, reprocess_by, reprocess: the status changes that the effects of touched rules ask for, each rule once, and what to read again.

    rules: rule_id, kind, scope, status, document_type, template, active_at (last activation that stands, null without one); effect_rows: rule_id, effect, at, seq, one a
    document; touched: rule_id, any number of times. A candidate is judged by all its effects, an active rule by those after its last activation, so that
    one reactivated by hand starts anew. Other statuses stay; a rule whose status stays has no row. A type rule has its template read again, others their type.

    All is sums and a rule's two last effects, which are limited before the shuffle: no task holds a rule's effects.
    """
    open_ = rules.where("status in ('CANDIDATE', 'ACTIVE')").join(touched.select("rule_id").distinct(), "rule_id", "left_semi")
    yes, no = F.col("effect") == "POSITIVE", F.col("effect") == "NEGATIVE"
    rows = effect_rows.select("rule_id", "effect", "at", "seq").join(open_.select("rule_id", "active_at"), "rule_id").withColumn("since", F.col("active_at").isNull() | F.coalesce(F.col("at") > F.col("active_at"), F.lit(False)))
    sums = rows.groupBy("rule_id").agg(
        F.count_if(yes).alias("support"), F.count_if(no).alias("negatives"), F.count_if("since").alias("n"), F.count_if(F.col("since") & yes).alias("confirmed"), F.count_if(F.col("since") & no).alias("denied")
    )
    newest = Window.partitionBy("rule_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    lasts = rows.where("since").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= NEGATIVE_STREAK).groupBy("rule_id").agg((F.count_if(no) == NEGATIVE_STREAK).alias("streak"))
    judged = open_.join(sums, "rule_id").join(lasts, "rule_id", "left")
    up = (F.col("status") == "CANDIDATE") & promotes(F.col("kind"), F.col("scope"), F.col("support"), F.col("negatives"))
    down = (F.col("status") == "ACTIVE") & suspends(F.col("kind"), F.col("n"), F.col("confirmed"), F.col("denied"), F.col("streak"))
    moved = judged.withColumn("after", F.when(up, "ACTIVE").when(down, "SUSPENDED")).where("after is not null")
    by_template = F.coalesce((F.col("kind") == "TEMPLATE_TYPE") & F.col("template").isNotNull(), F.lit(False))
    return moved.select(
        "rule_id", F.col("status").alias("before"), "after", F.when(F.col("after") == "ACTIVE", "RULE_PROMOTED").otherwise("RULE_SUSPENDED").alias("action"),
        F.when(by_template, "template").otherwise("document_type").alias("reprocess_by"), F.when(by_template, F.col("template")).otherwise(F.col("document_type")).alias("reprocess"),
    )


def since_active(effect_rows: DataFrame, activations: DataFrame) -> DataFrame:
    """Effects strictly after the rule's last activation; all of them for a rule without one."""
    last = activations.groupBy("rule_id").agg(F.max("at").alias("active_at"))
    return effect_rows.join(last, "rule_id", "left").where(F.col("active_at").isNull() | (F.col("at") > F.col("active_at")))


def rule_key(kind: Column, scope: Column, document_type: Column, template: Column, field: Column, relation: Column, label: Column) -> Column:
    return F.concat_ws("|", kind, scope, document_type, F.when(scope == "TEMPLATE", template).otherwise("*"), field, relation, label)


#: Transitions that a reviewer may make by hand.
MANUAL = {"ACTIVE": ["SUSPENDED", "REJECTED"], "SUSPENDED": ["ACTIVE", "REJECTED"], "CANDIDATE": ["REJECTED"]}


def legal_transition(before: Column, after: Column) -> Column:
    legal = F.lit(False)
    for b, targets in MANUAL.items():
        legal = legal | ((before == b) & after.isin(targets))
    return legal


def rollback(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """Rules whose newest un-reverted manual change may be rolled back, with the status that this restores."""
    newest = actions.where("reverted_at is null and kind in ('RULE_SUSPENDED', 'RULE_REACTIVATED', 'RULE_REJECTED')").groupBy("rule_id").agg(F.max_by(F.struct("before_state", "after_state"), F.struct("at", "seq")).alias("a"))
    return rules.join(newest, "rule_id").where(F.col("a.after_state") == F.col("status")).select("rule_id", F.col("a.before_state").alias("restored"))


def snapshot_fingerprint(rules: DataFrame) -> DataFrame:
    """Sixteen hex digits over the sorted keys of the active rules, hashed one after the other: the keys are never held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, between = hashlib.sha256(), b""
        for b in batches:
            for key in b.column(0).to_pylist():
                digest.update(between + key.encode())
                between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:16]])], ["fingerprint"])

    keys = rules.where("status = 'ACTIVE' and rule_key is not null").select("rule_key").repartition(1).sortWithinPartitions("rule_key")
    none = hashlib.sha256().hexdigest()[:16]  # without a key there may be no task
    return keys.mapInArrow(run, "fingerprint string").agg(F.coalesce(F.max("fingerprint"), F.lit(none)).alias("fingerprint"))

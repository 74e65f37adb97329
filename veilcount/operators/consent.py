"""The consent ledger: hash-chained lanes, one for each workspace, and what they permit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.constants import DAY_US, POSTURES, PURPOSES, STRICTEST
from veilcount.functions import identity
from veilcount.sources.tables import saved

GENESIS = "0" * 64
#: Hex digits that name a leaf of the tree over all lanes.
DEPTH = 4
#: A subject's events of so long a time are looked at together.
SLOT_US = DAY_US


def canonical(r: Column) -> Column:
    return F.concat_ws("|", r["subject_key"], r["purpose"], r["state"], r["source"], r["at"].cast("string"), r["jurisdiction"], r["notice_version"])


def append(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chains a batch: every record gets its place in the lane, the hash before it and its own.

    ``records``: workspace_id, seq (order of arrival), subject_key, purpose,
    state, source, at, jurisdiction, notice_version. ``heads`` continues lanes:
    (workspace_id, length, head). A chain is sequential by its nature, so a
    lane is read by one task, in order, without being held in memory.
    """
    fields = ("at", "seq", "subject_key", "purpose", "state", "source", "jurisdiction", "notice_version")
    given = records.select("workspace_id", *fields)
    if heads is not None:
        before = heads.select("workspace_id", F.col("length").alias("base"), F.col("head").alias("start"))
        given = given.join(before, "workspace_id", "left")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, place, last = None, 0, GENESIS
        for b in batches:
            places, before, own = [], [], []
            for workspace, start, base, text in zip(*(b[c].to_pylist() for c in ("workspace_id", "start", "base", "text")), strict=True):
                if (workspace,) != lane:
                    lane, place, last = (workspace,), base, start
                places.append(place)
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                own.append(last)
                place += 1
            kept = b.drop_columns(["base", "start", "text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], [*kept.schema.names, "place", "prev_hash", "hash"])

    in_order = given.repartition("workspace_id").sortWithinPartitions("workspace_id", *fields)
    # what can be had from a sorted row isn't sorted with it
    base, start = (F.lit(None), F.lit(None)) if heads is None else (F.col("base"), F.col("start"))
    texts = in_order.withColumns({"base": F.coalesce(base.cast("long"), F.lit(0).cast("long")), "start": F.coalesce(start, F.lit(GENESIS)), "text": canonical(F.struct(*fields))})
    schema = given.select("workspace_id", *fields).schema.add("place", "long").add("prev_hash", "string").add("hash", "string")
    return texts.mapInArrow(chain, schema).select("workspace_id", "place", *fields, "prev_hash", "hash")


def from_decisions(decisions: DataFrame, root: str) -> DataFrame:
    """Records of explicit decisions: one for each (purpose, boolean) of the map ``purposes``, on the stable anchor.

    ``decisions``: workspace_id, identifier, purposes, jurisdiction,
    notice_version, at, seq. Blank jurisdictions are ``unknown``, blank notices
    ``unversioned``; a missing identifier or an empty map gives no record. The
    anchor outlives the epochs of subject keys, and so does the decision.
    """
    keyed = identity.with_keys(decisions, root).where("anchor is not null")
    each = keyed.select("*", F.explode(F.map_entries("purposes")).alias("p")).where("p.value is not null")
    filled = lambda c, text: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text)).alias(c)
    return each.select(
        "workspace_id", "seq", F.col("anchor").alias("subject_key"), F.col("p.key").alias("purpose"), F.when(F.col("p.value"), "granted").otherwise("denied").alias("state"),
        F.lit("explicit_ui").alias("source"), "at", filled("jurisdiction", "unknown"), filled("notice_version", "unversioned"),
    )


def heads(chain: DataFrame) -> DataFrame:
    """(workspace_id, length, head) of every lane."""
    return chain.groupBy("workspace_id").agg((F.max("place") + 1).alias("length"), F.max_by("hash", "place").alias("head"))


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), "|"), 256)


def commitments(lanes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, prefix, children, hash): a hash tree over ``lanes`` (workspace_id, head).

    A lane lies in the leaf that the first ``depth`` hex digits of its
    workspace's hash name; a node commits to its children, of which inner
    nodes have sixteen at most and leaves about lanes / 16 ** depth. The last
    level, 0, is the root. Every level is one grouping, and none collects more
    than the level below has.
    """
    own = F.concat_ws(":", "workspace_id", "head").alias("child")
    level = lanes.select(F.substring(F.sha2(F.coalesce("workspace_id", F.lit("")), 256), 1, depth).alias("prefix"), own)
    out = None
    for n in range(depth, -1, -1):
        node = level.groupBy("prefix").agg(F.array_sort(F.collect_list("child")).alias("children")).select(F.lit(n).alias("level"), "prefix", "children", _joined(F.col("children")).alias("hash"))
        out = node if out is None else out.unionByName(node)
        level = node.select(F.substring("prefix", 1, n - 1).alias("prefix") if n > 1 else F.lit("").alias("prefix"), F.concat_ws(":", "prefix", "hash").alias("child"))
    return out


def ledger_head(chain: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row: the root over all lanes, 64 hex characters even for an empty ledger."""
    top = commitments(heads(chain), depth).where("level = 1").select(F.concat_ws(":", "prefix", "hash").alias("child"))
    # sixteen rows at most
    return top.agg(_joined(F.collect_list("child")).alias("head"))


def inclusion_proofs(asked: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(workspace_id, level, prefix, children) from leaf to root for each asked (workspace_id), from stored ``nodes``."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    path = asked.select("workspace_id").distinct().select("workspace_id", levels).withColumn("prefix", F.expr("substring(sha2(coalesce(workspace_id, ''), 256), 1, level)"))
    return path.join(nodes.select("level", "prefix", "children"), ["level", "prefix"]).select("workspace_id", "level", "prefix", "children")


def verified_inclusion(proofs: DataFrame, lanes: DataFrame, root: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(workspace_id, included): whether each proof leads from the lane's own head to the root (``root``: head)."""
    steps = proofs.select("workspace_id", "level", "children", F.concat_ws(":", "prefix", _joined(F.col("children"))).alias("child"))
    lane = lanes.select("workspace_id", F.lit(depth + 1).alias("level"), F.concat_ws(":", "workspace_id", "head").alias("child"))
    below = steps.select("workspace_id", "level", "child").unionByName(lane).select("workspace_id", (F.col("level") - 1).alias("level"), "child")
    held = below.where("level >= 0").join(steps.select("workspace_id", "level", "children"), ["workspace_id", "level"], "left")
    links = held.select("workspace_id", F.coalesce(F.array_contains("children", F.col("child")), F.lit(False)).alias("ok"))
    top = steps.where("level = 0").join(F.broadcast(root), F.lit(True)).select("workspace_id", (F.col("child") == F.concat(F.lit(":"), "head")).alias("ok"))
    return links.unionByName(top).groupBy("workspace_id").agg((F.bool_and("ok") & (F.count("*") == depth + 2)).alias("included"))


def differing_lanes(mine: DataFrame, theirs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(child) of the lanes whose heads differ between two stored trees: from the root down, only below nodes that differ."""
    changed = None
    for n in range(1, depth + 1):
        a, b = (t.where(F.col("level") == n).select("prefix", F.col("hash").alias(h)) for t, h in ((mine, "a"), (theirs, "b")))
        if changed is not None:
            a, b = (t.withColumn("up", F.substring("prefix", 1, n - 1)).join(changed, "up", "left_semi").drop("up") for t in (a, b))
        changed = a.join(b, "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("prefix").alias("up"))
    leaves = [t.where(F.col("level") == depth).join(changed, F.col("prefix") == F.col("up"), "left_semi").select(F.explode("children").alias("child"), F.lit(side).alias("side")) for t, side in ((mine, 1), (theirs, 2))]
    return leaves[0].unionByName(leaves[1]).groupBy("child").agg(F.count("*").alias("n")).where("n = 1").select("child")


def first_broken(chain: DataFrame) -> DataFrame:
    """(workspace_id, broken_at) of every lane: the place of its first entry that doesn't verify, or null."""
    before = chain.select("workspace_id", (F.col("place") + 1).alias("place"), F.col("hash").alias("expected"))
    own = F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), canonical(F.struct("subject_key", "purpose", "state", "source", "at", "jurisdiction", "notice_version"))), 256)
    joined = chain.join(before, ["workspace_id", "place"], "left")
    link = F.when(F.col("place") == 0, F.lit(GENESIS)).otherwise(F.col("expected"))
    bad = (own != F.col("hash")) | ~F.coalesce(link == F.col("prev_hash"), F.lit(False))
    return joined.groupBy("workspace_id").agg(F.min(F.when(bad, F.col("place"))).alias("broken_at"))


def posture(purpose: Column, jurisdiction: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, p in enumerate(PURPOSES):
        state = F.lit(STRICTEST[i])
        for name, states in POSTURES.items():
            state = F.when(jurisdiction == name, states[i]).otherwise(state)
        out = F.when(purpose == p, state).otherwise(out)
    return out


def in_force(mine: Column | None = None) -> Column:
    """An aggregate over records, of those that ``mine`` holds for: the state of the decision in force.

    Defaults written by a workspace or a regulation never overturn what the
    subject chose, and after a withdrawal only a grant given explicitly counts.
    So after one the last record counts that isn't another grant; what came
    before it is no later than the withdrawal itself. No record is looked at twice.
    """
    of = (lambda c: c) if mine is None else (lambda c: F.when(mine, c))
    own = ~F.col("source").isin("workspace_default", "regulatory_default")
    record = F.struct("at", "seq", "state")
    sure = own & ((F.col("state") != "granted") | (F.col("source") == "explicit_ui"))
    chose, gone = F.bool_or(of(own)), F.coalesce(F.bool_or(of(own & (F.col("state") == "withdrawn"))), F.lit(False))
    last = lambda c: F.max(of(F.when(c, record)))
    return F.when(chose & gone, last(sure)).when(chose, last(own)).when(~chose, F.max(of(record)))["state"]


def decisions(records: DataFrame) -> DataFrame:
    """(workspace_id, subject_key, purpose, state): the decision in force."""
    return records.groupBy("workspace_id", "subject_key", "purpose").agg(in_force().alias("state"))


def resolve(asked: DataFrame, records: DataFrame) -> DataFrame:
    """``asked`` (workspace_id, subject_key, purpose, jurisdiction) with the state in force."""
    found = asked.join(decisions(records), ["workspace_id", "subject_key", "purpose"], "left")
    return found.withColumn("state", F.coalesce("state", posture(F.col("purpose"), F.col("jurisdiction"))))


def permitted(subjects: DataFrame, records: DataFrame) -> DataFrame:
    """``subjects`` (workspace_id, subject_key, jurisdiction) with the purposes whose state is granted, in fixed order.

    Without workspace or subject nothing is permitted, whatever the jurisdiction.
    """
    state = records.groupBy("workspace_id", "subject_key").agg(*(in_force(F.col("purpose") == p).alias(p) for p in PURPOSES))
    found = subjects.join(state, ["workspace_id", "subject_key"], "left")
    known = F.col("workspace_id").isNotNull() & F.col("subject_key").isNotNull()
    each = [F.when(known & (F.coalesce(F.col(p), posture(F.lit(p), F.col("jurisdiction"))) == "granted"), F.lit(p)) for p in PURPOSES]
    return found.select(*subjects.columns, F.array_compact(F.array(*each)).alias("purposes"))


def states(records: DataFrame) -> DataFrame:
    """(workspace_id, subject_key, purpose, at, seq, state): what is in force from each record on, until the next of the same key.

    The rules of ``decisions``, applied to every beginning of the ledger: what
    the subject chose last and validly, and before any choice the last default.
    """
    keys = Window.partitionBy("workspace_id", "subject_key", "purpose").orderBy("at", "seq")
    own = ~F.col("source").isin("workspace_default", "regulatory_default")
    no_before = F.coalesce(F.max((own & (F.col("state") == "withdrawn")).cast("int")).over(keys.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    ignored = (F.col("state") == "granted") & (F.col("source") != "explicit_ui") & no_before
    marked = records.select("workspace_id", "subject_key", "purpose", "at", "seq", "state", own.alias("own"), ignored.alias("ignored"))
    so_far = keys.rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.last(F.when(F.col("own") & ~F.col("ignored"), F.col("state")), ignorenulls=True).over(so_far)
    default = F.last(F.when(~F.col("own"), F.col("state")), ignorenulls=True).over(so_far)
    return marked.select("workspace_id", "subject_key", "purpose", "at", "seq", F.coalesce(chosen, default).alias("state"))


def permitted_at(events: DataFrame, records: DataFrame, at: str = "at", slot_us: int = SLOT_US) -> DataFrame:
    """``events`` (workspace_id, subject_key, jurisdiction, ``at``, ...) with the purposes that were granted at the time of each.

    A record of the same moment counts already. States and events are sorted
    together, and each event takes the last state before it. A subject's events
    are cut into slots of time, each begun with the state at its start, so that
    the events of one very busy subject are many tasks' work; only the start of
    each slot and the records meet in one place. Without workspace or subject
    nothing is permitted.
    """
    key = ["workspace_id", "subject_key"]
    known = F.col("workspace_id").isNotNull() & F.col("subject_key").isNotNull()
    names = [f"p{i}" for i in range(len(PURPOSES))]
    given = events.select(*key, "jurisdiction", F.col(at).alias("t"), F.floor(F.col(at) / F.lit(slot_us)).alias("slot"), F.struct(*(F.col(c) for c in events.columns)).alias("e"))
    live = given.where(known)
    # written, so that the subjects' keys aren't made anew for each of its uses
    slots = saved(live.select(*key, "slot").distinct())
    # only records of subjects that have events
    marks = states(records.join(slots.select(*key).distinct(), key, "left_semi")).select(*key, F.col("at").alias("t"), F.floor(F.col("at") / F.lit(slot_us)).alias("slot"), "seq", *(F.when(F.col("purpose") == p, F.col("state")).alias(n) for p, n in zip(PURPOSES, names, strict=True)))
    none = [F.lit(None).cast("string").alias(n) for n in names]

    def last(over: list[str]) -> list[Column]:
        w = Window.partitionBy(*over).orderBy("t", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
        return [F.last(n, ignorenulls=True).over(w).alias(n) for n in names]

    starts = slots.select(*key, (F.col("slot") * F.lit(slot_us)).alias("t"), "slot", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("kind"), *none)
    whole = starts.unionByName(marks.withColumn("kind", F.lit(1)))
    begun = whole.select(*key, "t", "slot", "seq", "kind", *last(key)).where("kind = 0")
    inside = marks.withColumn("kind", F.lit(1)).join(slots, [*key, "slot"], "left_semi")
    empty = lambda df: df.select(*key, "t", "slot", F.col("seq").cast("long").alias("seq"), "kind", *names)
    rows = empty(begun).unionByName(empty(inside)).unionByName(live.select(*key, "t", "slot", F.lit(None).cast("long").alias("seq"), F.lit(2).alias("kind"), *none, "jurisdiction", "e"), allowMissingColumns=True)
    found = rows.select("kind", "jurisdiction", "e", *last([*key, "slot"])).where("kind = 2")
    each = [F.when(F.coalesce(F.col(n), posture(F.lit(p), F.col("jurisdiction"))) == "granted", F.lit(p)) for p, n in zip(PURPOSES, names, strict=True)]
    judged = found.select("e", F.array_compact(F.array(*each)).alias("purposes"))
    rest = given.where(~known).select("e", F.array().cast("array<string>").alias("purposes"))
    return judged.unionByName(rest).select("e.*", "purposes")


def withdrawals(subjects: DataFrame, seq: Column) -> DataFrame:
    """Records that withdraw all three purposes of each (workspace_id, subject_key, jurisdiction, at)."""
    return subjects.select(
        "workspace_id", seq.alias("seq"), "subject_key", F.explode(F.array(*map(F.lit, PURPOSES))).alias("purpose"),
        F.lit("withdrawn").alias("state"), F.lit("explicit_ui").alias("source"), "at", "jurisdiction", F.lit("unversioned").alias("notice_version"),
    )

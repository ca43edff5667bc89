"""Samples as a stream: each one's way through the stages, and a report that follows from new records alone.

The log keeps a state a sample, the report one of up to 1,024 samples whose ids are neighbours, so work follows the records that come and
what those hold, not all that came before. A sample's state is small (a stage; or its rollouts, of which a run asks for n): for many millions set
``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider, as ``session()`` does.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.functions.sampling import pass_at_k, pass_pow_k
from tallywright.operators.runlog import ACTIONS, NEVER_AGAIN, STAGES, compacted

#: What workers say about an action that they tried: seq grows with each of a sample's outcomes; action null means the one that was due.
OUTCOME = "sample_id long, seq long, action string, ok boolean, finalize boolean, reason string"
#: A record of the log; attempts counts the actions of a sample that failed.
RECORD = "sample_id long, seq long, iteration int, stage string, retry_count int, error_action string, error_reason string"
#: A rollout as it is judged; of records with one sample_id and idx the one with the greatest seq holds.
JUDGED = "sample_id long, idx long, seq long, correct boolean, vote string, extracted boolean"
#: What a report needs of a sample, and how many samples more (or, below zero, fewer) are like that.
CHANGE = "n long, c long, majority int, top long, n_unextracted long, weight long"

#: Ids of samples that are equal without so many low bits share one state in changes(): 1,024 samples at most.
TOGETHER = 10


class Progress(NamedTuple):
    """Where a sample stands."""

    seq: int = -1
    iteration: int = 0
    stage: str = "initial"
    retry_count: int = 0


def advanced(at: Progress, seq: int, action: str | None, ok: bool, finalize: bool, reason: str | None, max_retries: int, max_iterations: int) -> tuple[Progress, str | None, str | None] | None:
    """Where an outcome leads, with the action that failed and why it is over; None for an outcome that says nothing new.

    That is one that came before (seq), one of an action that isn't due, or one of a sample that has ended. A failure leaves the stage,
    to be tried again, until more than ``max_retries`` of a sample's actions failed or its reason forbids it. Feedback that doesn't
    finalise begins the next iteration, the last of which fails instead.
    """
    due = ACTIONS.get(at.stage)
    if seq <= at.seq or due is None or (action is not None and action != due):
        return None
    if not ok:
        if reason in NEVER_AGAIN:
            return at._replace(seq=seq, stage="failed"), due, reason
        tried = at._replace(seq=seq, retry_count=at.retry_count + 1)
        return (tried._replace(stage="failed"), due, "retry_limit") if tried.retry_count > max_retries else (tried, due, None)
    if at.stage != "feedback":
        return at._replace(seq=seq, stage=STAGES[STAGES.index(at.stage) + 1]), None, None
    if finalize:
        return at._replace(seq=seq, stage="final"), None, None
    if at.iteration + 1 >= max_iterations:
        return at._replace(seq=seq, stage="failed"), due, "iteration_limit"
    return at._replace(seq=seq, stage="initial", iteration=at.iteration + 1), None, None


def progressed(outcomes: DataFrame, max_retries: int = 3, max_iterations: int = 1, patience_ms: int | None = None) -> DataFrame:
    """The log (RECORD) of a stream of outcomes (OUTCOME): one record for each outcome that leads a sample on.

    Outcomes of one micro-batch are taken in order of seq. A null sample_id has no state and is left out; null ok counts as failed, null
    finalize as not. With ``patience_ms``, a sample that has begun, hasn't ended and isn't heard of so long counts a failure of the due
    action, for the reason ``timeout``, as if its worker had said so (seq stays).
    """

    def records(key: tuple[int], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = Progress(*state.get) if state.exists else Progress()
        if state.hasTimedOut:
            news: list[tuple[Any, ...]] = [(at.seq, None, False, False, "timeout")]
            at = at._replace(seq=at.seq - 1)
        else:
            fields = ["seq", "action", "ok", "finalize", "reason"]
            news = sorted((r for frame in rows for r in frame[fields].astype(object).itertuples(index=False, name=None)), key=lambda r: r[0])
        log = []
        for seq, action, ok, finalize, reason in news:
            step = advanced(at, int(seq), action if isinstance(action, str) else None, ok is True or ok == 1, finalize is True or finalize == 1, reason if isinstance(reason, str) else None, max_retries, max_iterations)
            if step is not None:
                at, failed, over = step
                log.append((key[0], at.seq, at.iteration, at.stage, at.retry_count, failed, over))
        state.update(tuple(at))
        if patience_ms is not None and at.stage in ACTIONS:
            state.setTimeoutDuration(patience_ms)
        if log:
            yield pd.DataFrame(log, columns=[c.split()[0] for c in RECORD.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return outcomes.where("sample_id is not null and seq is not null").groupBy("sample_id").applyInPandasWithState(records, RECORD, "seq long, iteration int, stage string, retry_count int", "append", timeout)


def due(log: DataFrame) -> DataFrame:
    """(sample_id, iteration, action) of samples that haven't ended, by their latest records: what the workers are to try next."""
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    last = log.groupBy("sample_id").agg(F.max_by(F.struct("iteration", "stage"), F.struct("seq", "retry_count")).alias("at"))
    return last.select("sample_id", "at.iteration", actions[F.col("at.stage")].alias("action")).where("action is not null")


def _standing(rollouts: dict[str, list[Any]]) -> tuple[int, ...]:
    """n, c, majority, top and n_unextracted of a sample's rollouts (seq, correct, vote, extracted) by idx.

    Blank votes don't count. The majority is 1 if one answer alone is the commonest and any of its rollouts is correct.
    """
    votes, right = Counter(), set()
    for _, correct, vote, _ in rollouts.values():
        if vote:
            votes[vote] += 1
            if correct:
                right.add(vote)
    top = max(votes.values(), default=0)
    first = [v for v, k in votes.items() if k == top]
    return len(rollouts), sum(r[1] for r in rollouts.values()), int(len(first) == 1 and first[0] in right), top, sum(not r[3] for r in rollouts.values())


def changes(judged: DataFrame) -> DataFrame:
    """What a stream of judged rollouts (JUDGED) changes in a report (CHANGE): a sample's old standing is taken back, its new one is put in.

    A record replaces one of the same sample_id and idx with a smaller seq; one that comes again, or late, changes nothing. Null correct
    and extracted are false; rows with a null sample_id, idx or seq are left out. Samples whose ids are neighbours share a state and a call
    of Python, and what they change is summed before it leaves.
    """

    def moved(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        was: dict[str, tuple[int, ...] | None] = {}
        for frame in frames:
            for sample_id, idx, seq, correct, vote, extracted in zip(*[frame[c].tolist() for c in ("sample_id", "idx", "seq", "correct", "vote", "extracted")], strict=True):
                sample, at = str(sample_id), str(idx)
                rollouts = known.setdefault(sample, {})
                if at not in rollouts or rollouts[at][0] < seq:
                    if sample not in was:
                        was[sample] = _standing(rollouts) if rollouts else None
                    rollouts[at] = [int(seq), bool(correct), vote if isinstance(vote, str) else "", bool(extracted)]
        if not was:
            return
        state.update((json.dumps(known, separators=(",", ":")),))
        moves: Counter[tuple[int, ...]] = Counter()
        for sample, before in was.items():
            moves[_standing(known[sample])] += 1
            if before is not None:
                moves[before] -= 1
        if any(moves.values()):
            yield pd.DataFrame([(*standing, k) for standing, k in moves.items() if k], columns=[c.split()[0] for c in CHANGE.split(", ")])

    rows = judged.where("sample_id is not null and idx is not null and seq is not null").select(
        F.shiftright("sample_id", TOGETHER).alias("block"), "sample_id", "idx", "seq", F.coalesce("correct", F.lit(False)).alias("correct"), F.trim(F.coalesce("vote", F.lit(""))).alias("vote"), F.coalesce("extracted", F.lit(False)).alias("extracted")
    )
    return rows.groupBy("block").applyInPandasWithState(moved, CHANGE, "rollouts string", "append", GroupStateTimeout.NoTimeout)


def summed(changed: DataFrame) -> DataFrame:
    """Changes of equal standing as one: few rows, whatever the number of samples. Sums of sums are sums, so it works on any part and again."""
    return changed.groupBy("n", "c", "majority", "top", "n_unextracted").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def report_of(changed: DataFrame, requested: Column, n: int, k: int) -> DataFrame:
    """The sampling report (one row) of all changes so far; ``requested`` is the number of samples asked for. The same as from the rollouts."""
    num, c, times = F.col("n"), F.col("c"), F.col("weight")

    def mean(value: Column) -> Column:
        return F.coalesce(F.round(F.sum(value * times) * 100 / F.nullif(requested, F.lit(0)), 6), F.lit(0.0))

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(of), F.lit(0))

    nothing, judged = F.lit(None).cast("double"), total(times)
    return summed(changed).agg(
        mean(pass_at_k(num, c, 1)).alias("pass_at_1"), (mean(pass_at_k(num, c, k)) if k > 1 else nothing).alias("pass_at_k"), (mean(pass_pow_k(num, c, k)) if k > 1 else nothing).alias("pass_pow_k"),
        (mean(F.col("majority")) if k == n else nothing).alias("majority_at_k"), mean(F.col("top") / num).alias("self_consistency"), mean(c / num).alias("avg_at_n"),
        F.lit(n).alias("n"), F.lit(k).alias("k"), total(F.when(num < n, times)).alias("n_short"), total(F.col("n_unextracted") * times).alias("n_unextracted"),
        requested.alias("requested"), judged.alias("judged"), (requested - judged).alias("fails"), F.lit("requested").alias("denominator_policy"),
    )


def kept(frame: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch, every: str | None = None):
    """Starts a stream into a folder, one part a micro-batch; a batch that is run again replaces its part, so nothing is doubled or lost.

    ``every`` ("16 seconds") is the time between flushes of a stream that goes on; without it the stream ends once it has read all there
    is. Started again with the same checkpoint, a stream goes on where it was stopped.
    """

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    writer = frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def parts_of(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All parts that streams left in a folder."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(target)


def latest(log: DataFrame) -> DataFrame:
    """The latest record of each sample of a log (RECORD)."""
    return compacted(log.select(*[c.split()[0] for c in RECORD.split(", ")]), tie="seq")

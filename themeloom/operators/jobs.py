"""Analytics over the attempt log: retries, claimable jobs, leases, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.ordered import first_rows, scan
from themeloom.sources import schema

JOB = ["job_type", "original_input_id"]

# Fixed values.
RETRY_BASE_SECONDS = 5
RETRY_MAX_SECONDS = 300
MAX_ATTEMPTS = 5
LEASE_SECONDS = 300
MAX_ERROR_CHARS = 4000


def retry_delay(attempts: Column, base: float = RETRY_BASE_SECONDS, cap: float = RETRY_MAX_SECONDS) -> Column:
    """base * 2^(attempts - 1), never above ``cap``."""
    exponent = F.greatest(attempts - 1, F.lit(0)).cast("double")
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), exponent), F.lit(float(cap)))


def _plus_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + F.round(seconds * 1_000_000).cast("long"))


def with_verdict(df: DataFrame, base: float, cap: float, max_attempts: int) -> DataFrame:
    terminal = F.col("attempts") >= max_attempts
    delay = retry_delay(F.col("attempts"), base, cap)
    return df.withColumns(
        {
            "delay_seconds": F.when(~terminal, delay),
            "status": F.when(terminal, "failed").otherwise("pending"),
            "available_at": F.when(~terminal, _plus_seconds(F.col("failed_at"), delay)),
        }
    )


def retry_fold(
    failures: DataFrame,
    base: float = RETRY_BASE_SECONDS,
    cap: float = RETRY_MAX_SECONDS,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Every failed attempt with its attempt number, backoff, and the status it leads to.

    ``failures``: event_id, job_type, original_input_id, failed_at.  A job may own a third of the
    log, so attempts are numbered by the distributed scan rather than one window per job.
    """
    if max_attempts < 1 or base <= 0 or cap < base:
        raise ValueError("need max_attempts >= 1 and 0 < base <= cap")
    numbered = scan(failures, JOB, ["failed_at", "event_id"], sums={"attempts": F.lit(1).cast("long")})
    return with_verdict(numbered, base, cap, max_attempts)


def retry_state(
    failures: DataFrame,
    base: float = RETRY_BASE_SECONDS,
    cap: float = RETRY_MAX_SECONDS,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Where each job stands after all its failures; a plain aggregation, also over a stream."""
    state = failures.groupBy(*JOB).agg(
        F.count(F.lit(1)).alias("attempts"), F.max("failed_at").alias("failed_at")
    )
    return with_verdict(state, base, cap, max_attempts)


def lease_expired(jobs: DataFrame, as_of: Column, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    limit = _plus_seconds(as_of, F.lit(-float(lease_seconds)))
    return jobs.where((F.col("status") == "processing") & (F.col("locked_at") < limit))


def claimable(
    jobs: DataFrame, as_of: Column, limit: int, lease_seconds: float = LEASE_SECONDS
) -> DataFrame:
    """Per job type the ``limit`` jobs to take next: due, and pending or with an expired lease."""
    expired = (F.col("status") == "processing") & (
        F.col("locked_at") < _plus_seconds(as_of, F.lit(-float(lease_seconds)))
    )
    due = jobs.where((F.col("available_at") <= as_of) & ((F.col("status") == "pending") | expired))
    return first_rows(due, ["job_type"], ["available_at", "id"], limit)


def requeue_failed(jobs: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The whole job table with the chosen failed jobs reset."""
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    reset = F.col("_chosen").isNotNull() & (F.col("status") == "failed")
    null_text, null_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    return (
        jobs.join(chosen, "id", "left")
        .withColumns(
            {
                "attempts": F.when(reset, F.lit(0)).otherwise(F.col("attempts")),
                "available_at": F.when(reset, as_of).otherwise(F.col("available_at")),
                "last_error": F.when(reset, null_text).otherwise(F.col("last_error")),
                "completed_at": F.when(reset, null_time).otherwise(F.col("completed_at")),
                "status": F.when(reset, "pending").otherwise(F.col("status")),
            }
        )
        .select(*jobs.columns)
    )


def queue_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type", "status").agg(F.count(F.lit(1)).alias("jobs"))


def next_job(status: Column) -> Column:
    """The job type a status calls for; NULL for a status that calls for none."""
    chain = None
    for name, job in schema.NEXT_JOB.items():
        chain = F.when(status == name, job) if chain is None else chain.when(status == name, job)
    return chain


def status_transitions(history: DataFrame) -> DataFrame:
    """Status changes of (input_id, version, status) rows, with the job each one queues.

    The first status counts as a change; a repeated status queues nothing.
    """
    seen = scan(history, ["input_id"], ["version"], previous={"previous_status": "status"})
    changed = seen.where(~F.col("status").eqNullSafe(F.col("previous_status")))
    return changed.withColumn("job_type", next_job(F.col("status")))


def clip_error(text: Column) -> Column:
    return F.substring(text, 1, MAX_ERROR_CHARS)


def store_failures(
    jobs: DataFrame,
    errors: DataFrame,
    base: float = RETRY_BASE_SECONDS,
    cap: float = RETRY_MAX_SECONDS,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """``jobs`` after the failures of (id, error, failed_at): one more attempt, the error's first characters, no lock.

    Only jobs in processing can fail; other rows of ``errors`` change nothing.  Of several errors of one job the last counts.
    A job that may be tried again waits for its delay; one that may not keeps its time.
    """
    last = errors.groupBy("id").agg(F.max(F.struct("failed_at", "error")).alias("_last"))
    joined = jobs.join(last, "id", "left").withColumn("_fails", F.col("_last").isNotNull() & (F.col("status") == "processing"))
    attempts = F.col("attempts") + 1
    terminal, when = attempts >= max_attempts, F.col("_last.failed_at")
    waits = _plus_seconds(when, retry_delay(attempts, base, cap))
    changes = {
        "status": F.when(terminal, "failed").otherwise("pending"),
        "available_at": F.when(terminal, F.col("available_at")).otherwise(waits),
        "last_error": clip_error(F.col("_last.error")),
        "locked_at": F.lit(None).cast("timestamp"), "locked_by": F.lit(None).cast("string"),
        "attempts": attempts,
    }
    return joined.select(*[
        F.when(F.col("_fails"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns
    ])

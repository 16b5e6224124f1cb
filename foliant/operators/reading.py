"""Reading activity: sessions, local days, status history, positions, device sync, annotations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ordering import Key, previous_row
from foliant.operators.folding import fold_sorted

IDLE_MS = 5 * 60 * 1000
FINISHED_AT = 0.995
STALE_AFTER_S = 5 * 60
QUARTER_MS = 15 * 60 * 1000
TOUCH_EVERY_S = 3600


# --- sessions ------------------------------------------------------------------------


NEVER = float("inf")


@dataclass(frozen=True)
class Session:
    """A reading session as moments in milliseconds.

    ``origin`` is where its segment begins, ``upto`` how far time is counted,
    ``deadline`` when it falls idle without a further action, ``shut`` when it ended.
    """

    segment: int
    origin: int
    upto: int
    deadline: int
    counted: int = 0
    shut: float = NEVER


def _taken_over(s: Session | None, row, idle_ms: int) -> Session | None:
    """Another session begins: an open one ends now, or at its deadline if that has passed."""
    if s is None or s.shut < NEVER:
        return s
    return replace(s, shut=max(s.upto, min(row.received_at, s.deadline)))


def _started(s: Session | None, row, idle_ms: int) -> Session | None:
    """The first segment opens a session; a later one goes on with it while it is alive."""
    now = row.received_at
    if s is None:
        return Session(0, now, now, now + idle_ms) if row.segment == 0 else None
    if row.segment <= s.segment or s.shut < NEVER or now >= s.deadline:
        return s
    origin = max(now, s.upto)
    return replace(s, segment=row.segment, origin=origin, upto=origin, deadline=origin + idle_ms)


def _reported(s: Session | None, row, idle_ms: int) -> Session | None:
    """Time counts up to the moment reported, but not beyond the deadline or the end."""
    if s is None or row.segment != s.segment:
        return s
    told = s.origin + min(row.elapsed_ms, max(0, row.received_at - s.origin))
    action = min(told, s.origin + row.last_activity_ms)
    deadline = max(s.deadline, action + idle_ms) if action < s.deadline else s.deadline
    shut = min(s.shut, deadline) if told >= deadline else s.shut
    upto = max(s.upto, int(min(told, deadline, shut)))
    return replace(s, upto=upto, deadline=deadline, counted=s.counted + upto - s.upto, shut=upto if row.finished and told >= upto else shut)


_RULES = {"takeover": _taken_over, "start": _started, "checkpoint": _reported}


def session_event(s: Session | None, row, idle_ms: int = IDLE_MS) -> tuple[Session | None, int, int]:
    """The session after a start, checkpoint or takeover, and the span that newly counts; spans never overlap."""
    after = _RULES[row.kind](s, row, idle_ms)
    if row.kind != "checkpoint" or after is None or row.segment != after.segment:
        return after, 0, 0
    return after, s.upto, after.upto


def with_takeovers(events: DataFrame) -> DataFrame:
    """Add, to every session, the moment its user starts the next one.

    That is the only influence between a user's sessions, so they can be
    folded independently of each other.
    """
    starts = events.where("kind = 'start' AND segment = 0").groupBy("user_id", "source_id").agg(F.min("received_at").alias("received_at"))
    moments = starts.withColumn("day", F.floor(F.col("received_at") / 86_400_000))
    later = previous_row(moments, ["user_id"], [Key(-F.col("received_at")), Key(F.col("source_id"))], -F.col("day"),
                         ["received_at"], "next").where("next IS NOT NULL")
    takeovers = later.select("user_id", "source_id", F.lit("takeover").alias("kind"), F.col("next.received_at").alias("received_at"))
    return events.unionByName(takeovers, allowMissingColumns=True)


def reading_sessions(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Every event with the span it newly counted and its session's total so far.

    ``events`` is (user_id, source_id, kind start/checkpoint, segment,
    elapsed_ms, last_activity_ms, finished, received_at, seq).
    """
    def step(state, row):
        state, start, end = session_event(state, row, idle_ms)
        if state is None:
            return None, (0, 0, 0, None)
        return state, (start, end, state.counted, None if state.shut == NEVER else int(state.shut))

    rows = with_takeovers(events).select("user_id", "source_id", "kind", F.coalesce("segment", F.lit(0)).alias("segment"),
                                         F.coalesce("elapsed_ms", F.lit(0)).alias("elapsed_ms"),
                                         F.coalesce("last_activity_ms", F.lit(0)).alias("last_activity_ms"),
                                         F.coalesce("finished", F.lit(False)).alias("finished"), "received_at",
                                         F.coalesce("seq", F.lit(-1)).alias("seq"))
    return fold_sorted(rows, ["user_id", "source_id"], ["received_at", "seq"],
                       "span_from bigint, span_to bigint, counted_ms bigint, closed_at bigint", step)


def session_totals(folded: DataFrame) -> DataFrame:
    """(user_id, source_id, counted_ms, closed_at) after the last event of each session."""
    last = F.struct("received_at", "seq")
    return folded.groupBy("user_id", "source_id").agg(F.max("counted_ms").alias("counted_ms"), F.max_by(F.struct("closed_at"), last).alias("c")).select(
        "user_id", "source_id", "counted_ms", F.col("c.closed_at").alias("closed_at"))


def session_days(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Active milliseconds per local calendar day.

    ``spans`` is (keys..., time_zone, span_from, span_to). Spans are cut at
    quarter hours of UTC, where all current zones change their offset, and
    each piece belongs to the local date of its beginning.
    """
    first = (F.floor(F.col("span_from") / QUARTER_MS) + 1) * QUARTER_MS
    cuts = F.when(first < F.col("span_to"), F.sequence(first, F.col("span_to") - 1, F.lit(QUARTER_MS).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    bounds = F.concat(F.array("span_from"), cuts, F.array("span_to"))
    pieces = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1),
                         lambda b, i: F.struct(b.alias("a"), F.get(bounds, i + 1).alias("z")))
    cut = spans.where("span_to > span_from").select(*keys, "time_zone", F.explode(pieces).alias("p"))
    day = F.date_format(F.from_utc_timestamp(F.timestamp_millis("p.a"), F.col("time_zone")), "yyyy-MM-dd")
    return cut.groupBy(*keys, day.alias("day")).agg(
        F.min("p.a").alias("started_at"), F.max("p.z").alias("ended_at"), F.sum(F.col("p.z") - F.col("p.a")).alias("active_ms"))


# --- status --------------------------------------------------------------------------


def day_slice(column: str) -> Column:
    return F.floor(F.col(column) / 86400)


def reading_status(requests: DataFrame) -> DataFrame:
    """Status history: one event per real change, linked to its predecessor; unread is the start.

    ``requests`` is (id, user_id, book_id, status, source, at_s), ids rising in arrival order.
    """
    keys, order = ["user_id", "book_id"], [Key(F.col("at_s")), Key(F.col("id"))]
    seen = previous_row(requests, keys, order, day_slice("at_s"), ["status"], "before")
    seen = seen.withColumn("from_status", F.coalesce(F.col("before.status"), F.lit("unread")))
    changes = seen.where(F.col("from_status") != F.col("status"))
    linked = previous_row(changes.drop("before"), keys, order, day_slice("at_s"), ["id"], "prior")
    return linked.select("id", "user_id", "book_id", F.col("prior.id").alias("previous_event_id"), "from_status",
                         F.col("status").alias("to_status"), "source", F.col("at_s").alias("occurred_at"))


def current_status(events: DataFrame) -> DataFrame:
    """State per user and book after its last event."""
    last = F.struct("occurred_at", "id")
    return events.groupBy("user_id", "book_id").agg(F.max_by(F.struct("to_status", "id", "occurred_at"), last).alias("e")).select(
        "user_id", "book_id", F.col("e.to_status").alias("status"), F.col("e.id").alias("last_event_id"), F.col("e.occurred_at").alias("updated_at"))


def status_after_progress(status: Column, progress: Column) -> Column:
    """Reading from unread, finished near the end; finished and dropped stay."""
    open_ended = status.isin("unread", "reading")
    return F.when(open_ended & (progress >= FINISHED_AT), F.lit("finished")).when(open_ended, F.lit("reading")).otherwise(status)


def status_with_progress(requests: DataFrame) -> DataFrame:
    """Final status of mixed histories: manual choices, and progress between them.

    Only the last choice and the largest progress after it matter, so the
    history is reduced by two aggregates. Manual rows have source 'manual'.
    """
    keys, order = ["user_id", "book_id"], F.struct("at_s", "id")
    manual = requests.where("source = 'manual'").groupBy(*keys).agg(F.max_by(F.struct("status", "at_s", "id"), order).alias("m"))
    moves = requests.where("source <> 'manual'").join(manual, keys, "left")
    after = F.col("m").isNull() | (order > F.struct(F.col("m.at_s").alias("at_s"), F.col("m.id").alias("id")))
    reached = moves.where(after).groupBy(*keys).agg(F.max("progress").alias("progress"))
    both = manual.join(reached, keys, "full_outer").withColumn("status", F.coalesce(F.col("m.status"), F.lit("unread")))
    moved = status_after_progress(F.col("status"), F.col("progress"))
    return both.select(*keys, F.when(F.col("progress").isNull(), F.col("status")).otherwise(moved).alias("status"))


def undo_status(requests: DataFrame, events: DataFrame, state: DataFrame) -> DataFrame:
    """(user_id, book_id, event_id, undone, status, last_event_id) of undo requests.

    Only the latest event, made automatically and ending in finished, can be taken back.
    """
    past = events.select(F.col("id").alias("event_id"), "user_id", "book_id", "from_status", "to_status", "source", "previous_event_id", "reverted_at")
    rows = requests.join(state, ["user_id", "book_id"], "left").join(past, ["user_id", "book_id", "event_id"], "left")
    may = ((F.col("last_event_id") == F.col("event_id")) & F.col("reverted_at").isNull() & (F.col("to_status") == "finished")
           & (F.col("source") != "manual"))
    undone = F.coalesce(may, F.lit(False))
    return rows.select("user_id", "book_id", "event_id", undone.alias("undone"),
                       F.when(undone, F.col("from_status")).otherwise(F.coalesce("status", F.lit("unread"))).alias("status"),
                       F.when(undone, F.col("previous_event_id")).otherwise(F.col("last_event_id")).alias("last_event_id"))


# --- positions -----------------------------------------------------------------------


def latest_position(writes: DataFrame) -> DataFrame:
    """Current position per user and asset: last write, revision count, null progress after a reset.

    ``writes`` is (user_id, asset_id, seq, progress, device_id, arrived_at,
    is_reset); repeating a reset changes nothing.
    """
    keys, order = ["user_id", "asset_id"], [Key(F.col("arrived_at")), Key(F.col("seq"))]
    seen = previous_row(writes, keys, order, day_slice("arrived_at"), ["is_reset"], "before")
    real = seen.where(~F.col("is_reset") | ~F.coalesce(F.col("before.is_reset"), F.lit(False)))
    last = F.struct("arrived_at", "seq")
    value = F.struct(F.when(~F.col("is_reset"), F.col("progress")).alias("progress"),
                     F.when(F.col("is_reset"), F.lit("")).otherwise(F.col("device_id")).alias("device_id"), "arrived_at")
    return real.groupBy(*keys).agg(F.max_by(value, last).alias("p"), F.count(F.lit(1)).alias("revision")).select(
        *keys, "p.progress", "p.device_id", "revision", F.col("p.arrived_at").alias("updated_at"))


def _judged_write(state, row):
    """state: (progress, address, revision, updated_at) of the position in place; None before the first."""
    place, revision, updated = (state[:2], *state[2:]) if state else (None, 0, 0)
    wanted = (row.progress, row.address)
    if place == wanted:
        return state, ("same", revision)
    if row.expected_revision is not None:
        refused = row.expected_revision != revision
    else:
        # Device clocks differ a little; only a clearly older and smaller position is a delayed one.
        refused = place is not None and row.progress < place[0] and row.modified_at < updated - STALE_AFTER_S
    if refused:
        return state, ("conflict", revision)
    return (*wanted, revision + 1, row.arrived_at), ("accepted", revision + 1)


def position_conflicts(writes: DataFrame) -> DataFrame:
    """Outcome of each write: same content, conflict, or accepted with its new revision.

    A write that names the revision it was based on (``expected_revision``) needs
    that revision to be in place. One that names none conflicts only if it is a
    smaller position dated well before the last update. Every write has a progress.
    """
    return fold_sorted(writes, ["user_id", "asset_id"], ["arrived_at", "seq"], "outcome string, revision bigint", _judged_write)


def status_after_writes(writes: DataFrame, states: DataFrame) -> DataFrame:
    """(user_id, book_id, status) after position writes: those accepted or saved advance the status, each from the one before.

    ``writes`` is (user_id, book_id, progress, outcome), ``states`` (user_id, book_id,
    status). Finished and dropped stay, and progress only ever leads from reading to
    finished, so the largest progress of the counted writes decides.
    """
    moved = writes.where(F.col("outcome").isin("accepted", "saved", "adopted")).groupBy("user_id", "book_id").agg(F.max("progress").alias("reached"))
    both = states.select("user_id", "book_id", "status").join(moved, ["user_id", "book_id"], "full_outer")
    status = F.coalesce("status", F.lit("unread"))
    return both.select("user_id", "book_id", F.when(F.col("reached").isNull(), status).otherwise(
        status_after_progress(status, F.col("reached"))).alias("status"))


def fill_position_cache(positions: DataFrame, filled: DataFrame) -> DataFrame:
    """Fill an empty locator only while the revision is still the one it was computed for."""
    extra = filled.select("user_id", "asset_id", "revision", F.col("locator").alias("new_locator"))
    empty = F.coalesce("locator", F.lit("")).isin("", "{}")
    return positions.join(extra, ["user_id", "asset_id", "revision"], "left").select(
        "user_id", "asset_id", "revision", F.when(empty, F.coalesce("new_locator", "locator")).otherwise(F.col("locator")).alias("locator"))


# --- device sync ---------------------------------------------------------------------


@dataclass
class _Document:
    """What a user's document holds: the address in place, whether the library has it, the last word of each device."""

    address: str | None = None
    in_library: bool = False
    said: dict = field(default_factory=dict)

    def take(self, row) -> str:
        first = self.address is None
        news = first or row.address not in (self.address, self.said.get(row.device_id))
        joins = row.known and not self.in_library and not first
        self.said[row.device_id] = row.address
        self.in_library = self.in_library or row.known and (news or joins)
        if news:
            self.address = row.address
            return "saved"
        return "adopted" if joins else "ignored"


def _uploaded(state: _Document | None, row):
    state = state or _Document()
    return state, (state.take(row), state.address)


def sync_uploads(uploads: DataFrame) -> DataFrame:
    """Outcome of native uploads per user and document: repeats of a device and echoes are ignored.

    ``uploads`` is (user_id, document, device_id, address, known, arrived_at,
    seq); a position kept for an unknown document is adopted once it is known.
    """
    return fold_sorted(uploads, ["user_id", "document"], ["arrived_at", "seq"], "outcome string, current_address string", _uploaded)


def resolve_document(hashes: DataFrame, assets: DataFrame, books: DataFrame) -> DataFrame:
    """(hash, asset_id, book_id): the unique live asset, else the unique live book, else 0."""
    alive = books.where(F.col("deleted_at").isNull()).select(F.col("id").alias("book_id"))
    rows = hashes.join(assets.select(F.col("id").alias("asset_id"), "book_id"), "asset_id").join(alive, "book_id", "left_semi")
    return rows.groupBy("hash").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("asset_id")).otherwise(0).alias("asset_id"),
        F.when(F.min("book_id") == F.max("book_id"), F.min("book_id")).otherwise(0).alias("book_id"))


@dataclass(frozen=True)
class _Bookmark:
    """A book on a device: its place with a revision and a date, and its status with a date."""

    address: str = ""
    progress: float = 0.0
    revision: int = 0
    placed_at: int = 0
    status: str = "unread"
    status_at: int = 0

    def moved_by(self, row) -> _Bookmark:
        """The place that a row tells, if it is a newer one. Without a full address only progress tells places apart."""
        if row.address is None:
            return self
        at = min(row.modified_at, row.arrived_at)
        progress = self.progress if row.progress is None else row.progress
        here = self.revision > 0 and row.address == self.address and (row.address != "" or progress == self.progress)
        if here or (self.revision > 0 and at < self.placed_at):
            return self
        return replace(self, address=row.address, progress=progress, revision=self.revision + 1, placed_at=at)

    def told_by(self, row, moved: bool) -> _Bookmark:
        """The status that a row tells, or that its new place implies at the place's own date."""
        if row.status:
            status, at = row.status, row.status_at
        elif moved:
            status, at = self.status, row.modified_at
            if status in ("unread", "reading"):
                status = "finished" if self.progress >= FINISHED_AT else "reading"
        else:
            return self
        at = min(at, row.arrived_at)
        echo = self.status == "dropped" and status == "reading"
        return self if at < self.status_at or echo or status == self.status else replace(self, status=status, status_at=at)


def _bookmarked(state: _Bookmark | None, row):
    before = state or _Bookmark()
    placed = before.moved_by(row)
    after = placed.told_by(row, placed is not before)
    return after, (placed is not before, after is not placed, after.revision, after.status)


def late_updates(updates: DataFrame) -> DataFrame:
    """Device bookmarks arriving late: older ones lose, future stamps are cut to now, equal places are ignored.

    A null address is a row without a place (a status alone); an empty one is a place
    without a full address; a null progress leaves the known one. A moved bookmark
    implies a status with the bookmark's own date; a dropped book is never turned
    back to reading.
    """
    return fold_sorted(updates, ["user_id", "asset_id"], ["arrived_at", "seq"],
                       "moved boolean, status_changed boolean, revision bigint, state string", _bookmarked)


def _annotation(state, row):
    """state: (generation, revision, live, note, color)."""
    generation, revision, live, note, color = state or (0, 0, False, "", "")
    if row.op == "create":
        if live:
            return state, ("exists", generation, revision)
        return (generation + 1, 1, True, row.note, row.color), ("created", generation + 1, 1)
    if generation == 0:
        return state, ("missing", 0, 0)
    if row.op == "delete":
        if not live:
            return state, ("gone", generation, revision)
        if row.revision != revision:
            return state, ("conflict", generation, revision)
        return (generation, revision + 1, False, "", color), ("deleted", generation, revision + 1)
    if not live:
        return state, ("conflict", generation, revision)
    if row.note == note and row.color == color:
        return state, ("applied", generation, revision)
    if row.revision != revision:
        return state, ("conflict", generation, revision)
    return (generation, revision + 1, True, row.note, row.color), ("updated", generation, revision + 1)


def annotation_log(ops: DataFrame) -> DataFrame:
    """Outcome of create, update and delete operations on each selection.

    Creating a live selection again returns it; an edit that is already in
    place succeeds whatever its revision; deleting leaves a tombstone.
    """
    return fold_sorted(ops, ["user_id", "asset_id", "selection"], ["at_s", "seq"],
                       "outcome string, generation bigint, new_revision bigint", _annotation)


def touch_throttle(uses: DataFrame, every_s: int = TOUCH_EVERY_S) -> DataFrame:
    """Last-used time per token: it advances at most once per hour.

    ``uses`` is (token, at_s). Uses are first reduced to the distinct seconds.
    """
    def step(state, row):
        at = int(row.at_s)
        advanced = state is None or at - state >= every_s
        return (at if advanced else state), (advanced,)

    walked = fold_sorted(uses.select("token", "at_s").distinct(), ["token"], ["at_s"], "advanced boolean", step)
    return walked.where("advanced").groupBy("token").agg(F.max("at_s").alias("last_used_at"), F.count(F.lit(1)).alias("writes"))

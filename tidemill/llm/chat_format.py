"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) to a string; nothing of its
inside is used. Successive prefixes of a conversation's turns are rendered and
consecutive outputs compared: what a turn adds is its span. A template that closes
its output (a trailer) puts turns in front of it; one that changes what it wrote
before rewrites history, which is reported, and spans that were rewritten lose
their loss mask. Where a turn's text stands inside its span is found by rendering
two stand-ins in its place: up to where these differ is the header, what they share
at their ends is the closing.

Turns are numbered within conversations over ranges of (conversation, turn), so
that a conversation of any length spreads over tasks. It is rendered in pieces of
PIECE turns, each behind the HISTORY turns before it and ahead of the one that
follows: for templates that look back no further, pieces put together are the
rendering of the whole. No task holds more than a piece at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, partitions, stored

PIECE = 32  # turns of a conversation that are rendered together
HISTORY = 8  # turns before them that a template may look back at
BATCH = 256  # pieces of an output batch
STAND_INS = ("q", "z")

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

# ---------------------------------------------------------------- a template with control strings

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of each control string, so that none is left."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[Turn]) -> str:
    """<s>, then [INST] of users, replies closed by </s>, [SYS] of systems, and [ROLE] with its name for any other role."""
    out = ["<s>"]
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        else:
            out.append(f"[ROLE] {escape(role)} [/ROLE] {text}[END]")
    return "".join(out)


def read(text: str) -> list[Turn]:
    """The turns of a rendering, or of a piece of one."""
    out, at = [], 3 if text.startswith("<s>") else 0
    while at < len(text):
        if text.startswith("[INST] ", at):
            end = text.index("[/INST]", at + 7)
            out.append(("user", unescape(text[at + 7 : end - 1])))
            at = end + 7
        elif text.startswith("[SYS] ", at):
            end = text.index("[/SYS]", at + 6)
            out.append(("system", unescape(text[at + 6 : end - 1])))
            at = end + 6
        elif text.startswith("[ROLE] ", at):
            named = text.index("[/ROLE]", at + 7)
            end = text.index("[END]", named + 8)
            out.append((unescape(text[at + 7 : named - 1]), unescape(text[named + 8 : end])))
            at = end + 5
        elif text[at] == " ":
            end = text.index("</s>", at + 1)
            out.append(("assistant", unescape(text[at + 1 : end])))
            at = end + 4
        else:
            raise ValueError(f"no turn begins at {at}")
    return out


# ---------------------------------------------------------------- spans by comparing renderings


def _shared(a: str, b: str, tail: bool = False) -> int:
    """Length of the longest common beginning, or end, of two strings; halves are compared, not characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if tail else a[low:mid] == b[low:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def _place(draw: Render, before: list[Turn], role: str, now: str) -> tuple[int, int] | None:
    """Where the text of the last turn stands in its rendering, or None where the template does not write it as it is."""
    x, y = (draw([*before, (role, s)]) for s in STAND_INS)
    head = _shared(x, y)
    tail = _shared(x[head:], y[head:], tail=True)
    if x[head : len(x) - tail] != STAND_INS[0] or len(now) < head + tail or now[:head] != x[:head] or now[len(now) - tail :] != x[len(x) - tail :]:
        return None
    return head, len(now) - tail


def spans(draw: Render, turns: list[Turn], trained: tuple[str, ...]) -> tuple[str, list[dict]]:
    """The rendering of all turns, and for each turn its span, its text's place if it is trained on, and whether it was rewritten.

    first_change: the turn whose arrival changed what had been written for this one.
    """
    try:
        prev = draw([])
    except Exception:  # many templates refuse an empty conversation
        prev = ""
    out: list[dict] = []
    tail = len(prev)  # what an empty conversation is closed with, unless the first turn comes behind it
    for k, (role, _) in enumerate(turns):
        now = draw(turns[: k + 1])
        start, end, kept = len(prev), len(now), True
        if not now.startswith(prev):
            start, low = _shared(prev, now), len(prev) - _shared(prev, now, tail=True)
            kept = low <= start
            if kept and low <= len(prev) - tail:  # where several places fit, that before the closing seen so far
                start = min(start, len(prev) - tail)
            tail = len(prev) - start if kept else _shared(prev[start:], now[start:], tail=True)
            end = len(now) - tail
        for s in out:
            if s["end"] is None or s["end"] <= start:
                continue
            if kept and (s["to"] is None or s["to"] <= start):
                s["end"] = max(start, s["start"])  # what was a trailer, or is one still
            else:
                s |= {"start": None, "end": None, "from": None, "to": None, "first_change": k if s["first_change"] is None else s["first_change"]}
        place = _place(draw, turns[:k], role, now) if role in trained else None
        out.append({"role": role, "start": start, "end": end, "from": place and place[0], "to": place and place[1], "first_change": None})
        prev = now
    return prev, out


# ---------------------------------------------------------------- whole tables

_SPAN = "struct<turn:long,role:string,start:int,end:int,from:int,to:int,rewritten:boolean>"
FORMATTED = f"conv_id long, piece long, whole boolean, n_turns int, text string, spans array<{_SPAN}>, rewritten_at long"
_SPAN_ARROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("rewritten", pa.bool_())])
_FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int32()), ("text", pa.string()), ("spans", pa.list_(_SPAN_ARROW)), ("rewritten_at", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Consecutive rows with equal values of some columns, one run at a time."""
    now, held = None, {}
    for b in batches:
        rows = b.to_pydict()
        for key, *row in zip(zip(*[rows[n] for n in names]), *rows.values()):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, {n: [] for n in rows}
            for n, v in zip(rows, row):
                held[n].append(v)
    if now is not None:
        yield now, held


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the place of each turn among those of its conversation in this task; rows come in order."""
    last, seen = None, 0
    for b in batches:
        ids = b.column("conv_id")
        key, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        at = np.arange(len(key))
        if not len(key):
            continue
        new = np.append(last != (key[0], none[0]), (key[1:] != key[:-1]) | (none[1:] != none[:-1]))
        begun = np.maximum.accumulate(np.where(new, at, -seen))
        local = at - begun
        last, seen = (key[-1], none[-1]), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "local"])


def _indexed(work: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, index): places of turns in their conversations, from 0; no task has more than its range."""
    spark = turns.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role"]
    # boundaries are sampled on the driver: a text's beginning is enough there, and equal rows are told apart by their number
    ranged = rows.repartitionByRange(partitions(spark), *order, F.substring("text", 1, 64), "row").sortWithinPartitions(*order, "text", "row")
    local = ranged.drop("row").withColumn("part", F.spark_partition_id()).mapInArrow(_local, "conv_id long, turn long, role string, text string, part int, local long")
    local = work.store(local, "chat-turns")
    # a range continues one conversation at most, so that those with an offset are not more than ranges
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = local.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0").select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), "before")
    found = local.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return found.select("conv_id", "turn", "role", "text", (F.col("local") + F.coalesce("before", F.lit(0))).alias("index"))


def format_conversations(turns: DataFrame, draw: Render = render, *, trained: tuple[str, ...] = ("assistant",), piece: int = PIECE, history: int = HISTORY) -> DataFrame:
    """(conv_id, piece, whole, n_turns, text, spans, rewritten_at): conversations as a stored table of formatted pieces.

    turns: (conv_id, turn, role, text). Turns come in the order of turn (null first),
    ties by role and text; repeated rows are turns of their own. A null text or role
    is empty, rows without conv_id are one conversation, other columns are ignored
    and an empty table gives an empty one. spans: for each turn of the piece its place
    in the piece's text, in code points, and from and to of the text to train on, null
    for other roles and where the template does not write the text as it is. A turn
    whose rendering changed later has no places and is marked as rewritten;
    rewritten_at is the first turn of the piece whose arrival did that. whole: the
    conversation has this piece only. A template that looks back further than history
    turns is seen with those alone in pieces after the first.
    """
    spark, work = turns.sparkSession, Scratch(turns.sparkSession)
    inside = F.col("index") % piece
    own = F.expr(f"index div {piece}")
    to = F.array(own, F.when(inside >= piece - history, own + 1), F.when((inside == 0) & (F.col("index") > 0), own - 1))
    dealt = _indexed(work, turns).withColumn("piece", F.explode(F.filter(to, lambda p: p.isNotNull())))
    dealt = dealt.repartition(partitions(spark), "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "index")

    def run(batches):
        rows = []
        for (conv, which), r in _runs(batches, "conv_id", "piece"):
            low = which * piece - r["index"][0]  # own turns come after those of the history
            high = min((which + 1) * piece - r["index"][0], len(r["index"]))
            if high <= low:
                continue  # history only: the conversation ended with the piece before
            text, found = spans(draw, list(zip(r["role"], r["text"])), trained)
            ahead = high < len(found)
            begin = 0 if which == 0 else found[low]["start"]
            until = found[high]["start"] if ahead else len(text)
            changes = [s["first_change"] for s in found[low:high] if s["first_change"] is not None]
            begin = until if begin is None else begin
            listed = []
            for s, turn in zip(found[low:high], r["turn"][low:high]):
                place = {n: None if s[n] is None else s[n] - begin for n in ("start", "end", "from", "to")}
                listed.append({"turn": turn, "role": s["role"], "rewritten": s["first_change"] is not None, **place})
            rows.append((conv, which, which == 0 and not ahead, high - low, text[begin:until], listed, r["turn"][min(changes)] if changes else None))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pydict(dict(zip(_FORMATTED_ARROW.names, zip(*rows))), schema=_FORMATTED_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(_FORMATTED_ARROW.names, zip(*rows))), schema=_FORMATTED_ARROW)

    out = stored(dealt.mapInArrow(lean(run), FORMATTED), "chat-formatted")
    work.clear()
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewritten long"
_DIGESTS_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewritten", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come in order; a hash takes in one piece at a time."""
    now, state, rows = None, None, []

    def ended():
        n, turns, chars, loss, size, rewritten = state
        return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, rewritten

    def batch():
        return pa.RecordBatch.from_pydict(dict(zip(_DIGESTS_ARROW.names, zip(*rows))), schema=_DIGESTS_ARROW)

    for b in batches:
        for conv, text, listed in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
            if now != (conv,):
                if now is not None:
                    rows.append(ended())
                    if len(rows) >= 4_096:
                        yield batch()
                        rows = []
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in read(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in listed:
                if s["from"] is not None:
                    said = unescape(text[s["from"] : s["to"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[5] += s["rewritten"]
            state[4] += len(text)
    if now is not None:
        rows.append(ended())
    if rows:
        yield batch()


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of formatted conversations finds: turns and loss texts, parsed out of the text again, as digests.

    Conversations of one piece are read where they lie. A longer one is hashed in
    order, which SHA-256 allows in one task only; that task holds one piece of it.
    """
    whole = formatted.where("whole").select("conv_id", "text", "spans").mapInArrow(lean(_digests), DIGESTS)
    longer = formatted.where("not whole").repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(longer.select("conv_id", "text", "spans").mapInArrow(lean(_digests), DIGESTS))

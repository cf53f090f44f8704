"""Repair of conversation structure by rank-convergence parallel Viterbi.

A conversation is its rows in the order of ``turn`` (nulls first; rows of one turn by role, then by the
SHA-256 of their text). A row that is blank or repeats an earlier (role, text) has to be deleted; every other row is
kept, given another role or deleted, and empty rows may be inserted, so that the role initials read ``(s?(ua)+)?`` at
least cost. Four automaton states (nothing yet, after s, after u, after a) make the costs-to-go of a place a vector of
four numbers; a row maps the vector behind it to the one before it.

Rows are numbered in their sorted order and cut into blocks of ``BLOCK``; a chunk is what one conversation has in
one block, so a conversation of any length is spread over tasks and a task holds one block. All chunks run
backwards at once from a speculative vector (that of the conversation's end, which is right for its last
chunk). Fix-up passes then hand every chunk the vector of its successor and rerun it until it differs from the earlier
run only by a constant; from there on the earlier run holds. Where nothing converges, the walks of a pass
cover four times as many chunks as those of the pass before, streamed, so passes stay logarithmic. The stitched costs drive the
trace: at every place the ASCII-least edit among those on a cheapest way. Its state at a chunk's entry follows
from the chunk's exit state for each entry state, composed along the chunks. Costs are kept up to a constant, as small integers.

Defined results: null conversation ids are one conversation, null turns sort first, null role or text counts
as one blank; equal rows of a turn are one row with a count; a role of any other initial is legal only after
another role was given; a conversation without rows appears in no table of ``repair`` and with zeros in
``report``; an empty table gives no rows; texts of any length are moved, never joined to one string; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, stored

#: Rows of a block; a power of two.
BLOCK = 4096
#: Costs of the edits; a kept or rerouted row whose text is cut short costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space of the contracts: blank and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The only user/assistant that may follow each:
FOLLOWS = (2, 2, 3, 2)
ROLE_AT = {2: "user", 3: "assistant"}
#: State after a kept row by its initial (s, u, a, other) and the state before.
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
FAR = 1 << 30

Vector = tuple[int, int, int, int]


# ---------------------------------------------------------------- the cost recurrence

def _inserts(c) -> Vector:
    """Costs with insertions before the place allowed."""
    u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + u), min(c[1], INSERT + u), u, a


#: Costs behind the last row: only "nothing yet" and "after a" may end.
END: Vector = _inserts((0, FAR, FAR, 0))


def before(kind: int, after: Vector) -> Vector:
    """Costs-to-go before a row from those behind it. Kind 0: must be deleted; else 1 + 2 * initial + cut short."""
    if kind == 0:
        return tuple(DELETE + x for x in after)
    initial, cut = divmod(kind - 1, 2)
    extra = TRUNCATED * cut
    costs = []
    for s in range(4):
        best = min(DELETE + after[s], REROLE + extra + after[FOLLOWS[s]])
        kept = KEPT[initial][s]
        costs.append(best if kept is None else min(best, extra + after[kept]))
    return _inserts(costs)


def _pack(v: Vector) -> int:
    """A vector up to a constant, as one integer (differences stay far below 256)."""
    low = min(v)
    return (v[0] - low) | (v[1] - low) << 8 | (v[2] - low) << 16 | (v[3] - low) << 24


def _unpack(p: int) -> Vector:
    return p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24 & 255


@lru_cache(maxsize=None)
def back(kind: int, packed: int) -> int:
    """``before`` on vectors up to a constant; few of them exist, so the cache stays small."""
    return _pack(before(kind, _unpack(packed)))


def trace(kinds: list[int], behind: int, state: int, last: bool) -> tuple[list[str], list[int], int]:
    """(edits at each row, state before them, state at the end) on the ASCII-least cheapest way from ``state``;
    edits are those before the row and its own, at the last row of a conversation also those behind it."""
    costs = [_unpack(behind)]
    for kind in reversed(kinds):
        costs.append(before(kind, costs[-1]))
    costs.reverse()
    edits, states = [], []
    for i, kind in enumerate(kinds):
        states.append(state)
        now, done = "", False
        initial, cut = divmod(kind - 1, 2)
        while not done:
            here, after = costs[i], costs[i + 1]
            if here[state] == DELETE + after[state]:
                letter, done = "D", True
            elif here[state] == INSERT + here[FOLLOWS[state]]:
                letter, state = "I", FOLLOWS[state]
            elif KEPT[initial][state] is not None and here[state] == TRUNCATED * cut + after[KEPT[initial][state]]:
                letter, state, done = "K", KEPT[initial][state], True
            else:
                letter, state, done = "R", FOLLOWS[state], True
            now += letter
        edits.append(now)
    if last and edits:
        while END[state]:
            edits[-1] += "I"
            state = FOLLOWS[state]
    return edits, states, state


def lines(edits: str, state: int, role: str, text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the messages that a row's edits leave, given the state before them."""
    for letter in edits:
        if letter == "I":
            state = FOLLOWS[state]
            yield ROLE_AT[state], ""
        elif letter == "R":
            state = FOLLOWS[state]
            yield ROLE_AT[state], text
        elif letter == "K":
            state = KEPT["sua".index(role[:1])][state]
            yield role, text


# ---------------------------------------------------------------- rows

def _key(conv: str) -> Column:
    return F.when(F.col(conv).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two stored tables in conversation order: the rows with their texts (place, ck, conv_id, turn, role, text, n) and, for all
    else, slim rows (place, block, ck, turn, n, blank, cut, initial, is_first, kind).

    ``n`` equal rows of a turn are one. ``kind`` is that of the first of them; the others are deleted.
    """
    clean = rows.select(_key("conv_id").alias("ck"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), "n")
    one = (clean.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
           .groupBy("ck", "conv_id", "turn", "role", "digest", "text").agg(F.sum("n").alias("n")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ck", F.col("turn").asc_nulls_first(), "role", "digest"]
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    sorted_rows = (one.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("place", F.monotonically_increasing_id())
                   .withColumn("blank", bare == "").withColumn("cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?")))
    table = stored(sorted_rows, "conversation-rows")
    # the first row of each (role, text) of a conversation; its place is its key
    first = (table.groupBy("ck", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first")))
    initial = F.substr("role", F.lit(1), F.lit(1))
    live = F.when(initial == "s", 1).when(initial == "u", 3).when(initial == "a", 5).otherwise(7) + F.col("cut").cast("int")
    slim = (table.select("place", "ck", "turn", "n", "blank", "cut", initial.alias("initial"), live.alias("live"))
            .join(first, "place", "left")
            .withColumn("kind", F.when(F.col("blank") | F.col("is_first").isNull(), 0).otherwise(F.col("live")))
            .withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")))
    return table, stored(slim.drop("live"), "conversation-kinds")


# ---------------------------------------------------------------- chunks

def _runs(keys: list) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal keys."""
    cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
    return list(zip([0, *cuts], [*cuts, len(keys)], strict=True))


_LEGAL = ("su", "ua", "au")


def _speculative(block: pd.DataFrame) -> pd.DataFrame:
    """Chunks of a block, run backwards from the vector of a conversation's end."""
    block = block.sort_values("place")
    keys, kinds, initial, n = (block[c].tolist() for c in ("ck", "kind", "initial", "n"))
    out = []
    for a, b in _runs(keys):
        v = _pack(END)
        for kind in reversed(kinds[a:b]):
            v = back(kind, v)
        bad = sum(x + y not in _LEGAL for x, y in zip(initial[a:b], initial[a + 1: b], strict=False)) + sum(n[a:b]) - (b - a)
        out.append((keys[a], int(block["block"].iloc[0]), initial[a], initial[b - 1], bad, _pack(END), v))
    return pd.DataFrame(out, columns=["ck", "block", "first", "last", "bad", "v_in", "v_out"])


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Rerun walks: rows sorted by (ck, walk, place descending) stream through; each walk enters its last
    chunk with ``start`` and every further one with what came out of the chunk behind it."""
    now = chunk = v = old = None
    v_in = settled = skip = 0

    def closed():
        return pa.RecordBatch.from_pylist([{"ck": chunk[0], "block": chunk[1], "v_in": v_in, "v_out": v}], schema=shape)

    shape = pa.schema([("ck", pa.string()), ("block", pa.int64()), ("v_in", pa.int64()), ("v_out", pa.int64())])
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("ck", "walk", "block", "kind", "was_in", "was_out", "start")]
        for ck, walk, block, kind, was_in, was_out, start in zip(*columns, strict=True):
            if chunk != (ck, block):
                if chunk is not None:
                    yield closed()
                if now != (ck, walk):
                    now, v = (ck, walk), start
                chunk, v_in, old = (ck, block), v, was_in
                settled = False
            if not settled and v == old:  # equal up to a constant: the earlier run holds from here on
                v, settled = was_out, True
            if not settled:
                v, old = back(kind, v), back(kind, old)
    if chunk is not None:
        yield closed()


def chunk_costs(kinds: DataFrame) -> DataFrame:
    """Stored chunks (ck, block, nth, is_last, bad, v_in): v_in is the right cost vector behind each chunk,
    ``bad`` its number of illegal neighbours, that with the chunk before it included."""
    made = kinds.select("block", "place", "ck", "kind", "initial", "n").groupBy("block").applyInPandas(
        _speculative, "ck string, block long, first string, last string, bad long, v_in long, v_out long")
    along = Window.partitionBy("ck").orderBy("block")
    chunks = stored(made.withColumn("nth", F.row_number().over(along)).withColumn("is_last", F.lead("block").over(along).isNull())
                    .withColumn("bad", F.col("bad") + (F.col("nth") > 1).cast("int") * (~F.concat(
                        F.coalesce(F.lag("last").over(along), F.lit("")), "first").isin(*_LEGAL)).cast("int")), "conversation-chunks")
    size = 4
    many = stored(chunks.where(~((F.col("nth") == 1) & F.col("is_last"))).select("ck", "block", "nth", "is_last", "v_in", "v_out"),
                  "conversation-cut")
    while True:
        linked = many.withColumn("start", F.when(F.col("is_last"), F.col("v_in")).otherwise(F.lead("v_out").over(along)))
        wrong = linked.where("start <> v_in")
        if wrong.isEmpty():
            break
        # walks of ``size`` chunks that hold a wrong start, entered at their last chunk
        at = F.floor(F.col("nth") / size).alias("walk")
        wanted = (linked.withColumn("walk", at).withColumn("wrong", (F.col("start") != F.col("v_in")).cast("int"))
                  .withColumn("n_wrong", F.sum("wrong").over(Window.partitionBy("ck", "walk")))
                  .withColumn("start", F.last("start").over(Window.partitionBy("ck", "walk").orderBy("block").rowsBetween(
                      0, Window.unboundedFollowing)))
                  .where("n_wrong > 0").select("ck", "block", "walk", "start", F.col("v_in").alias("was_in"), F.col("v_out").alias("was_out")))
        rows = (kinds.select("ck", "block", "place", "kind").join(wanted, ["ck", "block"]).repartition("ck", "walk")
                .sortWithinPartitions("ck", "walk", F.desc("place")))
        again = rows.mapInArrow(_walk, "ck string, block long, v_in long, v_out long").select(
            "ck", "block", F.col("v_in").alias("new_in"), F.col("v_out").alias("new_out"))
        many = stored(many.join(again, ["ck", "block"], "left").select(
            "ck", "block", "nth", "is_last", F.coalesce("new_in", "v_in").alias("v_in"),
            F.coalesce("new_out", "v_out").alias("v_out")), "conversation-cut")
        size *= 4
    right = many.select("ck", "block", F.col("v_in").alias("right_in"))
    return chunks.join(right, ["ck", "block"], "left").select(
        "ck", "block", "nth", "is_last", "bad", F.coalesce("right_in", "v_in").alias("v_in"))


def _exits(block: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Exit state of each chunk for every entry state."""
    block = block.sort_values("place")
    keys, kinds = block["ck"].tolist(), block["kind"].tolist()
    known = {c.ck: c for c in chunks.itertuples()}
    out = []
    for a, b in _runs(keys):
        if keys[a] in known:
            c = known[keys[a]]
            ends = [trace(kinds[a:b], c.v_in, s, c.is_last)[2] for s in range(4)]
            out.append((c.ck, c.block, c.nth, *ends))
    return pd.DataFrame(out, columns=["ck", "block", "nth", "e0", "e1", "e2", "e3"])


def _entries(batches) -> Iterator[pa.RecordBatch]:
    """Entry state of every chunk, from exit maps that stream past in order."""
    now, state = None, 0
    for batch in batches:
        keys = batch.column("ck").to_pylist()
        ends = list(zip(*(batch.column(f"e{s}").to_pylist() for s in range(4)), strict=True))
        entry = []
        for ck, e in zip(keys, ends, strict=True):
            if ck != now:
                now, state = ck, 0
            entry.append(state)
            state = e[state]
        yield pa.RecordBatch.from_arrays([batch.column("ck"), batch.column("block"), pa.array(entry, pa.int32())],
                                         names=["ck", "block", "entry"])


def _edits(block: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Edits of every row of a block."""
    block = block.sort_values("place")
    keys, kinds, n = block["ck"].tolist(), block["kind"].tolist(), block["n"].tolist()
    known = {c.ck: c for c in chunks.itertuples()}
    edits, states = [], []
    for a, b in _runs(keys):
        c = known[keys[a]]
        e, s, _ = trace(kinds[a:b], c.v_in, c.entry, c.is_last)
        # the other equal rows are deleted straight after the first, before anything behind it
        for i, m in enumerate(n[a:b]):
            if m > 1:
                own = max(j for j, x in enumerate(e[i]) if x != "I") + 1
                e[i] = e[i][:own] + "D" * (m - 1) + e[i][own:]
        edits += e
        states += s
    cost = [e.count("D") * DELETE + e.count("I") * INSERT + e.count("R") * REROLE
            + TRUNCATED * (k > 0 and (k - 1) % 2) * (("K" in e) + ("R" in e)) for e, k in zip(edits, kinds, strict=True)]
    return pd.DataFrame({"place": block["place"].tolist(), "edits": edits, "state": states, "cost": cost})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, n: copies): (per row: place, ck, conv_id, turn, role, text, n, edits, state, cost;
    per row: its faults; per chunk: illegal neighbours)."""
    ship_code(rows.sparkSession)
    table, kinds = ordered(rows)
    chunks = stored(chunk_costs(kinds), "conversation-costs")
    slim = kinds.select("block", "place", "ck", "kind", "n")
    cut = chunks.where(~((F.col("nth") == 1) & F.col("is_last")))
    exits = (slim.groupBy("block").cogroup(cut.select("ck", "block", "nth", "is_last", "v_in").groupBy("block"))
             .applyInPandas(_exits, "ck string, block long, nth long, e0 int, e1 int, e2 int, e3 int"))
    entries = (exits.repartition("ck").sortWithinPartitions("ck", "nth")
               .mapInArrow(_entries, "ck string, block long, entry int"))
    entered = chunks.join(entries, ["ck", "block"], "left").select(
        "ck", "block", "is_last", "v_in", F.coalesce("entry", F.lit(0)).alias("entry"))
    edits = (slim.groupBy("block").cogroup(entered.groupBy("block"))
             .applyInPandas(_edits, "place long, edits string, state int, cost long"))
    return table.drop("digest", "blank", "cut").join(edits, "place"), kinds, chunks


def messages(repaired: DataFrame) -> DataFrame:
    """(conv_id, place, nth, role, text): the repaired conversations, in the order of (place, nth)."""
    def run(batches):
        shape = pa.schema([("ck", pa.string()), ("place", pa.int64()), ("nth", pa.int32()), ("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    out += [{"ck": r["ck"], "place": r["place"], "nth": i, "role": role, "text": text}
                            for i, (role, text) in enumerate(lines(r["edits"], r["state"], r["role"], r["text"]))]
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    return repaired.select("ck", "place", "edits", "state", "role", "text").mapInArrow(
        run, "ck string, place long, nth int, role string, text string")


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """(ck, audit, repaired_sha256) of conversations whose rows stream past in order; one digest state is held."""
    shape = pa.schema([("ck", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, audit, sha, begun = None, [], None, False
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(at, 64).to_pylist():
                if r["ck"] != now:
                    if now is not None:
                        out.append({"ck": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    now, audit, sha, begun = r["ck"], [], hashlib.sha256(), False
                audit.append(r["edits"])
                for role, text in lines(r["edits"], r["state"], r["role"], r["text"]):
                    sha.update(("\n" if begun else "").encode() + role.encode() + b":")
                    sha.update(text.encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"ck": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=shape)


def report(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``originals``: faults of ``rows``, the cheapest edits and the digest of the repair.

    The audit and the digest of a conversation are one string and one running hash by their definition, so its rows
    stream through one task there, without being held; everything before that is spread by blocks.
    """
    repaired, kinds, chunks = repair(rows)
    repaired = stored(repaired, "conversation-edits")
    blank, first = F.col("blank"), F.col("is_first").isNotNull()
    faults = kinds.groupBy("ck").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("n") - first.cast("int"))).alias("duplicate"),
        F.sum((~blank & first & F.col("cut")).cast("long")).alias("truncated"))
    illegal = chunks.groupBy("ck").agg(F.sum("bad").alias("illegal"))
    cost = repaired.groupBy("ck").agg(F.sum("cost").alias("cost"))
    done = (repaired.select("ck", "place", "edits", "state", "role", "text").repartition("ck").sortWithinPartitions("ck", "place")
            .mapInArrow(_digests, "ck string, audit string, repaired_sha256 string"))
    every = originals.select(_key("conv_id").alias("ck"), "conv_id").distinct()
    out = every.join(faults, "ck", "left").join(illegal, "ck", "left").join(cost, "ck", "left").join(done, "ck", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


# ---------------------------------------------------------------- damage of the contract

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) of ``conversations`` after the damage that crc32(``conv_id:turn``) % 20
    names: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 doubles it, 4 makes it the user's."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("harm", F.crc32(F.encode(name, "UTF-8")) % 20).where("harm <> 0")
            .select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
                    F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                    F.when(F.col("harm") == 3, 2).otherwise(1).alias("n")))

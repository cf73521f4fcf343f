"""Conversation prefix trie by an LCP-aware external mergesort.

A turn is its 128-bit digest of role and text, and a conversation the concatenation of its turns' digests, so that bytes order
conversations turn by turn, a prefix first; texts are digested where they are read and never shuffled. Equal conversations are
counted into one record first (ids in blocks of 1,024, so a group of copies of any size is spread over tasks; the digest of its ids, in order,
is then taken from the blocks as they stream by). Spark deals the records to ranges of the order, each bounded in bytes; a range is sorted by one task:

1. Each run of RUN_ROWS records is sorted, and carries the LCP (in turns) of each record with the one before it.
2. A loser tree merges the runs. Contenders and losers know their LCP with the last record out: the longer one wins without a look at
   the turns, and only equal ones are compared, from there on. So no shared turn is compared again.
3. The merged stream, with its LCPs, feeds a stack that holds the open path. Nodes below the LCP are finished: they give their sums to
   the node above; their rows go out once that node is finished too, since they name its smallest member.

A range knows the last record of the range before and the first of the next. Nodes on both sides of such a border give a row in
each range, counted as new only in the first, and are added up by Spark; their children get the smallest member by a salted join.

Not held whole anywhere: a hot prefix is many ranges, a group of copies many blocks. One conversation's digests (16 bytes a turn) are one record.

Nulls: a null role or text is empty; turns are ordered with null first, ties by digest; rows without a conversation id belong to no
conversation and are left out. Repeated rows are turns each. `c % group` is SQL's remainder. Collisions of 128-bit digests are taken for equal
turns. Trees: an empty table gives no node, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlytics.llm.common import at, passing, stage, table

#: Bytes of a turn's digest.
UNIT = 16
#: Records of a run that is sorted in one go.
RUN_ROWS = 4096
#: Bytes of records in a range, about; what a task holds.
RANGE_BYTES = 16 << 20
#: Turns that tell ranges apart; conversations that share more still end up in one range, in right order.
LEAD_TURNS = 1024
#: Rows of an output batch.
OUT_ROWS = 8192
#: Ways to which children of one border node are dealt.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node_id string, parent_id string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array<token, words> in order."""
    role, text = (F.coalesce(at(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    token = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(at(conv_col).isNotNull()).select(at(conv_col).cast("long").alias("conv_id"), at(turn_col).alias("turn"), token.alias("token"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token", "words"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the group's first: h = crc32(id) % most, the group's first is id - id % group."""
    id_ = F.col("conv_id")
    heads = own.where(id_ % group == 0).select(id_.alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    rows = own.select("conv_id", "turns", (id_ - id_ % group).alias("base"), (F.crc32(id_.cast("string").cast("binary")) % most).cast("int").alias("h"))
    head = F.coalesce("head", F.slice("turns", 1, 0))  # typed and empty
    # A base has at most `group` conversations on either side of zero, and a head a few turns.
    return rows.join(heads, "base", "left").select("conv_id", F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))).alias("turns"))


def _fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and block -> a record for each path, with the digest of its ids."""
    now, out = None, []
    done = lambda: (now["key"], now["words"], now["n"], now["low"], now["ends"].hexdigest())
    for b in batches:
        for r in b.to_pylist():
            if now is None or r["path"] != now["path"]:
                if now is not None:
                    out.append(done())
                now = r | {"ends": hashlib.sha256(r["ids"].encode())}
            else:
                now["ends"].update(b"," + r["ids"].encode())
                now["n"] += r["n"]
                now["low"] = min(now["low"], r["low"])
        if out:
            yield _records(out)
            out = []
    if now is not None:
        yield _records([done()])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "words", "n", "low", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """key, words, n, low, ends: a record for each distinct sequence of turns."""
    key = F.unhex(F.array_join("turns.token", ""))
    rows = convs.select("conv_id", key.alias("key"), F.col("turns.words").cast("array<int>").alias("words"), F.shiftright("conv_id", 10).alias("block")).withColumn("path", F.md5("key"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = rows.groupBy("path", "block").agg(F.any_value("key").alias("key"), F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))
    return blocks.repartition("path").sortWithinPartitions("path", "block").mapInArrow(_fold_copies, "key binary, words array<int>, n long, low long, ends string")


def shared(a: bytes, b: bytes, k: int) -> int:
    """Turns that two keys have in common from the start, of which k are known."""
    n = min(len(a), len(b)) // UNIT
    step = 1
    while k < n:
        m = min(n, k + step)
        if a[k * UNIT : m * UNIT] == b[k * UNIT : m * UNIT]:
            k, step = m, step * 2
        elif m == k + 1:
            break
        else:
            step = max(1, (m - k) // 2)
    return k


def sorted_run(records: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Records in order of their keys, and each one's LCP with the one before."""
    run = sorted(records, key=lambda r: r[0])
    return run, [0] + [shared(a[0], b[0], 0) for a, b in zip(run, run[1:])]


def merged(runs: list[tuple[list[tuple], list[int]]]) -> Iterator[tuple[tuple, int]]:
    """All records of the runs in order, each with its LCP with the one before (the first: 0), by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    place = [0] * size

    def head(r: int) -> tuple[int, int]:
        """A run and the LCP of its head with the last record out; -1 if it has ended."""
        return (r, runs[r][1][place[r]]) if r < len(runs) and place[r] < len(runs[r][0]) else (r, -1)

    def play(one: tuple[int, int], other: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """The winner, and the loser with its LCP with the winner."""
        if one[1] != other[1] or one[1] < 0:
            return (one, other) if one[1] >= other[1] else (other, one)
        a, b = runs[one[0]][0][place[one[0]]][0], runs[other[0]][0][place[other[0]]][0]
        k = shared(a, b, one[1])
        if a[k * UNIT : (k + 1) * UNIT] <= b[k * UNIT : (k + 1) * UNIT]:
            return one, (other[0], k)
        return other, (one[0], k)

    losers: list = [None] * size
    level = [(r, 0) if head(r)[1] >= 0 else (r, -1) for r in range(size)]
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            winner, losers[(len(level) + i) // 2] = play(level[i], level[i + 1])
            up.append(winner)
        level = up
    winner = level[0]
    while winner[1] >= 0:
        r = winner[0]
        yield runs[r][0][place[r]], winner[1]
        place[r] += 1
        winner, node = head(r), (size + r) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Path:
    """The open path of the merged stream; rows of finished nodes are in `out`."""

    def __init__(self, before: bytes | None, after: bytes | None):
        self.before, self.after, self.out, self.stack, self.last = before, after, [], [], None

    def _open(self, words: int, token: bytes, new: bool) -> None:
        above = self.stack[-1]["hash"] if self.stack else None
        # Only nodes that a border may share need an id.
        name = above.copy() if above is not None else hashlib.md5() if not self.stack else None
        if name is not None:
            name.update(token)
        self.stack.append({"n": 0, "low": None, "children": 0, "leaves": 0, "saved": 0, "words": words, "ends": NO_ENDS, "new": new, "hash": name, "wait": []})

    def _close(self, goes_on: bool) -> None:
        x, depth = self.stack.pop(), len(self.stack)
        if x["new"] and not x["children"] and not goes_on:  # a node that began before the border has a child after it
            x["leaves"] = 1
        x["saved"] += (x["n"] - x["new"]) * x["words"]
        at_border = goes_on or not x["new"]
        node_id = x["hash"].hexdigest() if at_border else None
        for row in x["wait"]:
            self.out.append((*row[:2], None if at_border else x["low"], *row[3:], None, node_id))
        row = (x["low"], depth, None, x["n"], x["children"], x["leaves"], x["saved"], x["ends"])
        if self.stack:
            up = self.stack[-1]
            up["n"] += x["n"]
            up["low"] = x["low"] if up["low"] is None else min(up["low"], x["low"])
            up["children"] += x["new"]
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
        if at_border:  # so is the node above
            self.out.append((*row, node_id, self.stack[-1]["hash"].hexdigest() if self.stack else None))
        elif self.stack:
            self.stack[-1]["wait"].append(row)
        else:
            self.out.append((*row, None, None))

    def add(self, record: tuple, lcp: int) -> None:
        key, words, n, low, ends = record
        if self.last is None:
            lcp = -1 if self.before is None else shared(self.before, key, 0)
            self._open(0, b"", lcp < 0)
            known = lcp
        else:
            while len(self.stack) > lcp + 1:
                self._close(False)
            known = -1
        for d in range(len(self.stack), len(words) + 1):
            self._open(words[d - 1], key[(d - 1) * UNIT : d * UNIT], d > known)
        self.last, top = key, self.stack[-1]
        top["n"] += n
        top["low"] = low if top["low"] is None else min(top["low"], low)
        top["ends"] = ends

    def end(self) -> None:
        on = -1 if self.after is None else shared(self.last, self.after, 0)
        while self.stack:
            self._close(len(self.stack) - 1 <= on)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in NODE.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows), kinds)], list(names))


def _merge_ranges(run_rows: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range, its borders first -> its nodes."""
        now, runs, loose, border = None, [], [], {}

        def finish() -> Iterator[pa.RecordBatch]:
            if loose:
                runs.append(sorted_run(loose))
            path = _Path(border.get(0), border.get(1))
            for record, lcp in merged(runs):
                path.add(record, lcp)
                if len(path.out) >= OUT_ROWS:
                    yield _nodes(path.out)
                    path.out = []
            if path.last is not None:
                path.end()
            if path.out:
                yield _nodes(path.out)

        for b in batches:
            for r in b.to_pylist():
                if r["range"] != now:
                    if now is not None:
                        yield from finish()
                    now, runs, loose, border = r["range"], [], [], {}
                if r["kind"] < 2:
                    border[r["kind"]] = r["key"]
                    continue
                loose.append((r["key"], r["words"], r["n"], r["low"], r["ends"]))
                if len(loose) >= run_rows:
                    runs.append(sorted_run(loose))
                    loose = []
        if now is not None:
            yield from finish()

    return merge


def prefix_trie(convs: DataFrame, ranges: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, turns: array<token, words>).

    conv_id: smallest member; depth; parent_conv_id: the parent's smallest member; n_convs, n_children, n_leaves; saved_tokens: words
    that prefix sharing saves in the subtree; ends_sha256: digest of the ids that end here.
    """
    spark = convs.sparkSession
    sequences = stage(distinct_sequences(convs), "sequences")
    size = sequences.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = stage(sequences.repartitionByRange(ranges, F.substring("key", 1, LEAD_TURNS * UNIT)).withColumn("range", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("range")  # a row a range
    ends = ends.select("range", F.array(F.lag("last").over(order), F.lead("first").over(order)).alias("keys"))
    borders = ends.select("range", F.posexplode("keys").alias("kind", "key")).where("key is not null")
    rows = dealt.withColumn("kind", F.lit(2)).unionByName(borders, allowMissingColumns=True)
    nodes = stage(rows.repartition("range").sortWithinPartitions("range", "kind").mapInArrow(_merge_ranges(run_rows), NODE), "nodes")
    sums = [F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))]
    # All rows of a border node but one have the digest of no ids.
    own_ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256")
    border = stage(nodes.where("node_id is not null").groupBy("node_id").agg(*sums, own_ends, F.any_value("parent_id").alias("parent_id")), "border")
    shown = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    lows = border.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    below = nodes.where("node_id is null and parent_id is not null").unionByName(border.select(*border.columns, F.lit(None).cast("long").alias("parent_conv_id")))
    below = below.drop("parent_conv_id").withColumn("salt", F.pmod("conv_id", F.lit(SALTS)).cast("int")).join(lows, ["parent_id", "salt"], "left")
    return nodes.where("node_id is null and parent_id is null").select(*shown).unionByName(below.select(*shown))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    with passing(spark) as kept:
        out = stage(prefix_trie(rebuilt(conversations(table(spark, sf_dir, "conversations")))), "trie")
        kept.append(out)
    return out


#: CRC-32 of an id's decimal digits: a table-free fold over bytes and bits.
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end))"""
SQL = rf"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as p, sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) as k,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as w from conversations where conv_id is not null),
     own as (select conv_id, list(k order by p) as k, list(w order by p) as w from t group by conv_id),
     c as (select *, conv_id - conv_id % 20 as base, xor({_CRC}, 4294967295) % 4 as h from own),
     r as (select c.conv_id, coalesce(b.k, [])[1:h] || c.k[h + 1:] as k, coalesce(b.w, [])[1:h] || c.w[h + 1:] as w from c left join own b on b.conv_id = c.base),
     p as (select conv_id, d, array_to_string(k[1:d], '/') as node, case when d > 0 then array_to_string(k[1:d - 1], '/') end as up, case when d > 0 then w[d] else 0 end as w, d = len(k) as ends
           from (select *, unnest(range(0, len(k) + 1)) as d from r)),
     n as (select node, up, d, w, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from p group by node, up, d, w),
     kids as (select up, count(*) as n from n where up is not null group by up),
     path as (select distinct a.node as top, b.node as node from p a join p b on a.conv_id = b.conv_id and a.d <= b.d),
     below as (select top, sum((n.n_convs - 1) * n.w) as saved, count(*) filter (where kids.n is null) as leaves from path join n on n.node = path.node left join kids on kids.up = path.node group by top)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, below.leaves as n_leaves, cast(below.saved as bigint) as saved_tokens, n.ends_sha256
from n join below on below.top = n.node left join kids on kids.up = n.node left join n u on u.node = n.up
"""

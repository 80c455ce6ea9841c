"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and the closing token; all words that training lacks are one symbol. The root holds add-one
word frequencies. A context is a run of preceding words of any length within the text. It is considered if it occurs `least_count` times in
training, the context without its oldest word is a state (one of a single word: always) and the one without its newest word was considered. It becomes a state
if its next-symbol distribution diverges from its suffix's: count * divergence, estimated with each occurrence left out of its own
context's counts, must reach `least_gain` nats. Distributions are smoothed by absolute discounting of one: what is taken from the `kinds` of next symbols that
a context has is dealt out as the suffix state's distribution does, p(w | context) = (max(n(context, w) - 1, 0) + kinds * p(w | suffix)) / n(context), so
each adds up to 1. A token is scored in
the state of its longest retained context; the score is the log10 of the product. Contexts grow by a word a round until no
longer one is a state. No threshold depends on the corpus' size, and nothing is listed, broadcast or collected but the number of tokens and of words.

Documents are encoded once, into a table of blocks of about `block_tokens` tokens: distinct 64-bit word hashes (which stand for the words) and each token's place
among them. In a round every block sends its distinct transitions (a hash of all their words, with their number and their probability in the suffix' state), grouped by
context, each once, to the bucket of the context's hash. There all is known that a context needs: its count, the kinds of its next symbols, its gain. Each block gets back, in
the order in which they came, the transitions' new probabilities and whether they make a state and a considered context; it goes on to the next length with the tokens that
grow and adds the others' logarithms to their documents. So a length of context takes one exchange, only the last round's tokens are kept, and both tables are bucketed by block, so that they meet without moving.

A hot context (one of `bucket_keys` occurrences or more; there is at most one in so many tokens) would make its bucket large: its transitions are dealt by their own hashes and answered with their counts, and its kinds and its gain
are added up over these buckets. These numbers of hot contexts, and those of tokens and words, are all that reaches the driver. More blocks or buckets take no more memory of a task; `block_tokens` and `bucket_keys` bound it.

Nulls: a null text is empty and has the closing token alone; a null doc_id counts as the empty text in its fold. Repeated
rows are learned from and scored each. Extra columns are ignored. Without training documents N = V = 0 and all scores
are 0 (each token has probability 1, as the base formula gives it). An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import checkpoint, documents, fold_of, mix64, read_table, words_of

END = b"\n"  # no word: words hold no line breaks
SLICE_ROWS = 400  # whose words are held at once
BYTES_PER_TOKEN = 6  # about; only for the number of buckets
BLOCKS_A_PLACE = 8  # blocks in one bucket of the tables, about
WORDS_A_TOKEN, PAIRS_A_TOKEN = 0.3, 0.7  # distinct in a block; only for the number of buckets
PARTS, PART_BUCKETS = 3, 10  # a length's exchange is made in parts, so that less lies on disk at once; from so many buckets on
LATE, LATE_PLACES = 4, 8  # from this length on few tokens grow; buckets to one then
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
KEPT, MANY, HOT = 1, 2, 4  # of a transition: its context is a state; it makes a considered context, a hot one
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # as soon as a query ends, not when the driver collects its garbage


@dataclass
class Rules:
    least_count: int = 16
    least_gain: float = 3.0
    tokens: float = 0.0  # of training
    words: float = 0.0
    hot_count: int = 0


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    most = x.max(initial=0)
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes()


def wide(b: pa.Buffer, n: int) -> np.ndarray:
    """n numbers from `narrow`."""
    return np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct value, in order, a place; and each value's rank among them."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = np.diff(x[order]) != 0
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of one value begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def numbers(row: pa.Table, name: str, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), kind)


def encoded(docs: DataFrame, block_tokens: int) -> DataFrame:
    """A row per block: block, words (sorted hashes), tokens (places among them), lengths and teaches of its documents, rows (their other columns, as an Arrow stream)."""
    kept = [c for c in docs.columns if c not in ("text", "teaches")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers, tokens, lengths, teaches, rows, held = TaskContext.get().partitionId() << 33, Numbers(), [], [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal block, held
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            own = packed(pa.RecordBatch.from_struct_array(pa.concat_arrays(rows)))
            columns = [pa.array([x], pa.binary()) for x in (hashes[order].tobytes(), place[np.concatenate(tokens)].tobytes(), np.array(lengths, np.uint32).tobytes(), np.array(teaches, np.uint8).tobytes(), own)]
            out = pa.RecordBatch.from_arrays([pa.array([block]), *columns], ["block", "words", "tokens", "lengths", "teaches", "rows"])
            for x in (numbers, tokens, lengths, teaches, rows):
                x.clear()
            block, held = block + 1, 0
            return out

        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(lo, SLICE_ROWS)
                texts = [[*words_of(t), END] for t in b.column("text").to_pylist()]
                lengths += map(len, texts)
                teaches += b.column("teaches").to_pylist()
                tokens.append(np.fromiter((n for t in texts for n in map(numbers.__getitem__, t)), np.uint32, sum(map(len, texts))))
                rows.append(pa.StructArray.from_arrays([b.column(c) for c in kept], kept))
                held += len(tokens[-1])
                if held >= block_tokens:
                    yield emit()
        if rows:
            yield emit()

    return docs.mapInArrow(run, "block long, words binary, tokens binary, lengths binary, teaches binary, rows binary")


SENT = "bucket long, block long, context binary, sizes binary, code binary, p binary, count binary"
ANSWER = "block long, length long, bucket long, value binary, flags binary, hot_context binary, hot_of binary, hot_m binary, hot_p binary, tokens double, words double"
OWN = ["rows", "lengths", "teaches", "known", "base", "done"]  # of a block's documents: other columns, tokens, fold, known tokens, base score, score of the tokens that grow no more
STATE = f"block long, {', '.join(f'{c} binary' for c in OWN)}, asked long, asked_hot long, at binary, entry binary, context binary, hot binary, sizes binary, code binary, p binary, count binary"


def table_of(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))]))


def each_row(use: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from use(pa.Table.from_batches([b.slice(i, 1)])).combine_chunks().to_batches()

    return run


@dataclass
class Level:
    """Tokens, in order, whose context of the current length is considered, and their distinct transitions, grouped by context."""

    at: np.ndarray  # of each token: place in the block
    entry: np.ndarray  # its transition
    context: np.ndarray  # of each context: hash
    hot: np.ndarray
    sizes: np.ndarray  # number of its transitions
    code: np.ndarray  # of each transition: hash of context and token
    p: np.ndarray  # probability in the longest state so far
    count: np.ndarray  # in this block's training documents

    def stored(self) -> dict:
        big = np.repeat(self.hot, self.sizes).sum()
        out = {f.name: getattr(self, f.name).tobytes() for f in fields(self)} | {"at": narrow(np.diff(self.at, prepend=self.at.dtype.type(0))), "sizes": narrow(self.sizes), "count": narrow(self.count)}
        return out | {"asked": len(self.code), "asked_hot": int(big)}

    @classmethod
    def read(cls, row: pa.Table) -> Level:
        entry, context, hot, code, p = (numbers(row, c, t) for c, t in (("entry", np.uint32), ("context", np.uint64), ("hot", bool), ("code", np.uint64), ("p", np.float32)))
        at = np.cumsum(wide(numbers(row, "at", np.uint8), len(entry)))
        return cls(at.astype(np.uint32), entry, context, hot, wide(numbers(row, "sizes", np.uint8), len(context)), code, p, wide(numbers(row, "count", np.uint8), len(code)))

    @classmethod
    def grown(cls, at: np.ndarray, entry: np.ndarray, code: np.ndarray, p: np.ndarray, flags: np.ndarray, learns: np.ndarray, begins: np.ndarray | bool) -> tuple[Level, np.ndarray]:
        """The level of contexts longer by a word, and which tokens are in it; code, p, flags: of the transitions so far."""
        many, kept = (flags & MANY > 0)[entry], (flags & KEPT > 0)[entry]
        ok = np.zeros(len(at), bool)
        ok[1:] = kept[1:] & many[:-1] & (np.diff(at) == 1)
        ok &= ~np.asarray(begins)
        i = np.flatnonzero(ok)
        pair = entry[i - 1] * len(code) + entry[i]
        some, rank = ranked(pair)
        before, last = np.divmod(pair[some], max(1, len(code)))
        first = runs(before)
        contexts = before[first]
        count = np.bincount(rank[learns[i]], minlength=len(some))
        return cls(at[i], rank.astype(np.uint32), code[contexts], flags[contexts] & HOT > 0, np.diff(first, append=len(before)), mix64(code[before] * GOLDEN + code[last]), p[last].astype(np.float32), count), ok

    def dealt(self, buckets: int, hot_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each transition's context; the transitions in the order of their buckets; where each bucket begins, and the last ends."""
        context = np.repeat(self.context, self.sizes)
        bucket = np.where(np.repeat(self.hot, self.sizes), buckets + bucket_of(self.code, hot_buckets), bucket_of(context, buckets))
        order = np.argsort(bucket.astype(np.uint16 if buckets + hot_buckets < 2**16 else np.int64), kind="stable")
        return context, order, np.searchsorted(bucket[order], np.arange(buckets + hot_buckets + 1))

    def sent(self, block: int, buckets: int, hot_buckets: int, part: int = 0, parts: int = 1) -> pa.Table:
        """To every `parts`-th bucket."""
        context, order, cuts = self.dealt(buckets, hot_buckets)
        context, code, p, count, rows = context[order], self.code[order], self.p[order], self.count[order], []
        for k in range(part, buckets + hot_buckets, parts):
            lo, hi = cuts[k], cuts[k + 1]
            if lo < hi:
                first = runs(context[lo:hi])
                rows.append({"bucket": k, "block": block, "context": context[lo + first].tobytes(), "sizes": narrow(np.diff(first, append=hi - lo)), "code": code[lo:hi].tobytes(), "p": p[lo:hi].tobytes(), "count": narrow(count[lo:hi])})
        return table_of(SENT, rows)

    def answered(self, value: np.ndarray, flags: np.ndarray, buckets: int, hot_buckets: int, hot: HotContexts) -> tuple[np.ndarray, np.ndarray]:
        """Each transition's new probability and flags, from the answers in the order of the buckets."""
        context, order, _ = self.dealt(buckets, hot_buckets)
        p, flag = np.empty(len(order)), np.empty(len(order), np.uint8)
        p[order], flag[order] = value, flags
        big = np.flatnonzero(np.repeat(self.hot, self.sizes))
        if len(big):
            c, kinds, kept = hot.of(context[big])
            p[big] = np.where(kept, (np.maximum(p[big] - 1, 0) + kinds * self.p[big]) / c, self.p[big])
            flag[big] |= kept.astype(np.uint8) * np.uint8(KEPT)
        return p, flag


@dataclass
class HotContexts:
    """Sorted, with counts, kinds of next symbols and whether they are states."""

    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    c: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.searchsorted(self.context, context)
        return self.c[i], self.kinds[i], self.kept[i]


def gain_parts(m: np.ndarray, p: np.ndarray, c: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of learned transitions that occur m times, in nats."""
    return m * np.log((np.maximum(m - 2, 0) + (kinds - (m == 1)) * p) / (c - 1) / p)


def answers_of(table: pa.Table, length: int, rules: Rules, buckets: int) -> pa.Table:
    """Of one bucket: what each block gets back, and a row (its block is negative) of what the driver sums up."""
    k, block = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    codes = read("code", np.uint64)
    cuts = np.cumsum([0, *map(len, codes)])
    count = np.concatenate([wide(x, len(c)) for x, c in zip(read("count", np.uint8), codes, strict=True)])
    some, rank = ranked(np.concatenate(codes))
    m = np.bincount(rank, count)
    rows = [{"block": b, "length": length, "bucket": k} for b in block]
    total = {"block": -1 - k, "length": length, "bucket": k}
    if not length:
        n = m.astype(np.int64)[rank]
        for r, lo, hi in zip(rows, cuts, cuts[1:]):
            r["value"] = narrow(n[lo:hi])
        return table_of(ANSWER, [*rows, total | {"tokens": float(m.sum()), "words": float(np.sum(m > 0))}])
    codes, count = None, None
    contexts = read("context", np.uint64)
    context = np.repeat(np.concatenate(contexts), np.concatenate([wide(x, len(c)) for x, c in zip(read("sizes", np.uint8), contexts, strict=True)]))[some]
    p = np.concatenate(read("p", np.float32))[some].astype(float)
    own, of = ranked(context)
    learned = m > 0
    flags = (m >= rules.least_count) * np.uint8(MANY) + (m >= rules.hot_count) * np.uint8(HOT)
    if k >= buckets:
        value = m
        total |= {"hot_context": context[own].tobytes(), "hot_of": of[learned].astype(np.uint32).tobytes(), "hot_m": narrow(m[learned]), "hot_p": p[learned].astype(np.float32).tobytes()}
    else:
        c, kinds = np.bincount(of, m), np.bincount(of, learned)
        gains = np.bincount(of[learned], gain_parts(m[learned], p[learned], c[of[learned]], kinds[of[learned]]), len(own))
        kept = (gains >= rules.least_gain)[of]
        value = np.where(kept, (np.maximum(m - 1, 0) + kinds[of] * p) / np.maximum(c[of], 1), p)
        flags = flags + kept * np.uint8(KEPT)
    value, flags = value.astype(np.float32)[rank], flags.astype(np.uint8)[rank]
    for r, lo, hi in zip(rows, cuts, cuts[1:]):
        r |= {"value": value[lo:hi].tobytes(), "flags": flags[lo:hi].tobytes()}
    return table_of(ANSWER, [*rows, total])


def received(answers: pa.Table, length: int) -> list[dict]:
    """A block's answers, by bucket."""
    rows = [i for i, x in enumerate(answers.column("length").to_pylist()) if x == length]
    out = [{c: answers.column(c)[i] for c in ("bucket", "value", "flags")} for i in rows]
    return sorted(out, key=lambda x: x["bucket"].as_py())


def joined(answers: list[dict], name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x[name].as_buffer(), kind) for x in answers]])


class Block:
    """A block's documents and what is summed up over their tokens."""

    def __init__(self, row: pa.Table):
        self.row, self.lengths, self.teaches = row, numbers(row, "lengths", np.uint32), numbers(row, "teaches", bool)
        self.ends = np.cumsum(self.lengths, dtype=np.int64)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def sums(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, len(self.lengths))

    def stored(self, level: Level, known: np.ndarray, base: np.ndarray, done: np.ndarray) -> pa.Table:
        own = {c: self.row.column(c)[0].as_py() for c in ("rows", "lengths", "teaches")}
        return table_of(STATE, [{"block": self.row.column("block")[0].as_py(), **own, "known": known.tobytes(), "base": base.tobytes(), "done": done.tobytes(), **level.stored()}])

    def words_sent(self, buckets: int) -> pa.Table:
        words, tokens = numbers(self.row, "words"), numbers(self.row, "tokens", np.uint32)
        count = np.bincount(tokens[np.repeat(self.teaches, self.lengths)], minlength=len(words))
        cuts = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
        block = self.row.column("block")[0].as_py()
        return table_of(SENT, [{"bucket": k, "block": block, "code": words[lo:hi].tobytes(), "count": narrow(count[lo:hi])} for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi])

    def first_level(self, answers: pa.Table, rules: Rules, buckets: int) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After the answers about words: the level of one-word contexts, which tokens are in it, and of each token document, count and probability."""
        words, entry = numbers(self.row, "words"), numbers(self.row, "tokens", np.uint32).astype(np.int64)
        asked = np.bincount(bucket_of(words, buckets), minlength=buckets)
        n = np.concatenate([np.zeros(0, np.int64), *[wide(x["value"].as_buffer(), asked[x["bucket"].as_py()]) for x in received(answers, 0)]])
        p = (n + 1) / (rules.tokens + rules.words + 1)
        flags = np.uint8(KEPT) + (n >= rules.least_count) * np.uint8(MANY) + (n >= rules.hot_count) * np.uint8(HOT)
        begins = np.zeros(len(entry), bool)
        begins[self.ends - self.lengths] = True
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        level, ok = Level.grown(np.arange(len(entry), dtype=np.uint32), entry, words, p, flags, self.teaches[doc], begins)
        return level, ok, doc, n[entry], p[entry]

    def advanced(self, level: Level, answers: pa.Table, length: int, buckets: int, hot_buckets: int, hot: HotContexts, before: tuple | None = None) -> pa.Table:
        """The state with contexts longer by a word; before: known, base and done so far, else those of the state."""
        got = received(answers, length)
        p, flags = level.answered(joined(got, "value", np.float32), joined(got, "flags", np.uint8), buckets, hot_buckets, hot)
        entry, doc = level.entry.astype(np.int64), self.doc(level.at)
        after, ok = Level.grown(level.at, entry, level.code, p, flags, self.teaches[doc], False)
        known, base, done = before or (numbers(self.row, "known", np.int64), numbers(self.row, "base", float), numbers(self.row, "done", float))
        return self.stored(after, known, base, done + self.sums(doc[~ok], np.log10(p[entry[~ok]])))


class Rounds:
    """The bucketed tables of blocks, states and answers."""

    def __init__(self, docs: DataFrame, rules: Rules, block_tokens: int, bucket_keys: int):
        self.spark, self.rules, self.name = docs.sparkSession, replace(rules, hot_count=max(bucket_keys, rules.least_count)), f"suffix_tree_{uuid.uuid4().hex}"
        self.tokens = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / BYTES_PER_TOKEN
        self.places, self.bucket_keys = 2 ** max(3, int(math.log2(1 + self.tokens / block_tokens / BLOCKS_A_PLACE))), bucket_keys
        self.tables: list[str] = []
        self.write(encoded(docs, block_tokens), "blocks")

    def write(self, rows: DataFrame, name: str, places: int | None = None) -> None:
        self.tables.append(name)
        rows.write.mode("append").option("compression", "zstd").bucketBy(places or self.places, "block").saveAsTable(f"{self.name}_{name}")

    def drop(self, *names: str) -> None:
        for name in names or set(self.tables):
            self.spark.sql(f"drop table if exists {self.name}_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def buckets(self, keys: float) -> int:
        return max(4, int(keys / self.bucket_keys))

    def parts(self, keys: float) -> int:
        return PARTS if keys >= PART_BUCKETS * self.bucket_keys else 1

    def with_answers(self, name: str, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """use(row, answers) of each block; their tables' buckets are read side by side."""
        replies = answers.where("block >= 0").select("block", "length", "bucket", "value", "flags")
        return self.table(name).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(use, schema)

    def answer(self, sent: DataFrame, name: str, length: int, buckets: int) -> None:
        rules = self.rules
        self.write(sent.groupBy("bucket").applyInArrow(lambda t: answers_of(t, length, rules, buckets), ANSWER).repartition(self.places, "block"), name)

    def words(self) -> int:
        """Asks for the words' counts."""
        n = self.buckets(self.tokens * WORDS_A_TOKEN)
        self.answer(self.table("blocks").mapInArrow(each_row(lambda row: Block(row).words_sent(n)), SENT), "answers", 0, n)
        found = self.table("answers").where("block < 0").agg(F.sum("tokens"), F.sum("words")).first()
        self.rules.tokens, self.rules.words = round(found[0] or 0), round(found[1] or 0)
        return n

    def first_state(self, words: int) -> None:
        """One-word contexts: made anew from the blocks in each part, for they are many."""
        rules, keys = self.rules, self.tokens * PAIRS_A_TOKEN
        parts = self.parts(keys)
        n = self.buckets(keys), max(1, self.buckets(keys) // 2)

        def asks(part: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
            return lambda row, answers: Block(row).first_level(answers, rules, words)[0].sent(row.column("block")[0].as_py(), *n, part, parts)

        for part in range(parts):
            self.answer(self.with_answers("blocks", self.table("answers").where("length = 0"), asks(part), SENT), "answers", 1, n[0])
        hot = self.hot_contexts("answers")

        def use(row: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(row)
            level, ok, doc, count, p = block.first_level(answers, rules, words)
            base = block.sums(doc, np.log10((count + 1) / (rules.tokens + rules.words + 1)))
            return block.advanced(level, answers, 1, *n, hot, (block.sums(doc, count > 0).astype(np.int64), base, block.sums(doc[~ok], np.log10(p[~ok]))))

        self.write(self.with_answers("blocks", self.table("answers"), use, STATE), "state_2")
        self.drop("blocks", "answers")

    def next_state(self, length: int, asked: int, asked_hot: int) -> None:
        state, answers = f"state_{length}", f"answers_{length}"
        n, parts = (self.buckets(asked - asked_hot), max(1, int(asked_hot / self.bucket_keys))), self.parts(asked)

        def asks(part: int) -> Callable[[pa.Table], pa.Table]:
            return lambda row: Level.read(row).sent(row.column("block")[0].as_py(), *n, part, parts)

        for part in range(parts):
            self.answer(self.table(state).mapInArrow(each_row(asks(part)), SENT), answers, length, n[0])
        hot = self.hot_contexts(answers) if asked_hot else HotContexts()
        use = lambda row, got: Block(row).advanced(Level.read(row), got, length, *n, hot)
        places = max(8, self.places // LATE_PLACES) if length == LATE else self.places  # a power of two, like those before
        self.write(self.with_answers(state, self.table(answers), use, STATE), f"state_{length + 1}", places)
        self.places = places
        self.drop(state, answers)

    def hot_contexts(self, answers: str) -> HotContexts:
        """Counts, kinds and gains of hot contexts, added up over the buckets of their transitions."""
        least_gain, schema = self.rules.least_gain, "context long, x double, y double"
        rows = self.table(answers).where("block < 0 and hot_context is not null").select("hot_context", "hot_of", "hot_m", "hot_p")

        def summed(use: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
            def run(row: pa.Table) -> pa.Table:
                context, of, p = numbers(row, "hot_context"), numbers(row, "hot_of", np.uint32), numbers(row, "hot_p", np.float32).astype(float)
                x, y = use(context, of, wide(numbers(row, "hot_m", np.uint8), len(of)), p)
                return pa.table({"context": context.view(np.int64), "x": x, "y": y})

            got = rows.mapInArrow(each_row(run), schema).groupBy("context").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
            context = got.column("context").to_numpy().view(np.uint64)
            order = np.argsort(context)
            return context[order], got.column("x").to_numpy()[order], got.column("y").to_numpy()[order]

        context, c, kinds = summed(lambda context, of, m, p: (np.bincount(of, m, len(context)), np.bincount(of, minlength=len(context)).astype(float)))
        if not len(context):
            return HotContexts()
        hot = HotContexts(context, c, kinds, np.zeros(len(context), bool))

        def gains(context: np.ndarray, of: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c, kinds, _ = hot.of(context)
            return np.bincount(of, gain_parts(m, p, c[of], kinds[of]), len(context)), np.zeros(len(context))

        return replace(hot, kept=summed(gains)[1] >= least_gain)

    def run(self) -> str:
        """The name of the last state, when no token grows any more."""
        self.first_state(self.words())
        length = 2
        while (asked := self.table(f"state_{length}").agg(F.sum("asked"), F.sum("asked_hot")).first())[0]:
            self.next_state(length, *asked)
            length += 1
        return f"state_{length}"

    def scores(self, state: str, rows: str) -> DataFrame:
        def use(row: pa.Table) -> pa.Table:
            own = pa.ipc.open_stream(row.column("rows")[0].as_buffer()).read_all().to_struct_array().combine_chunks()
            columns = [own, *[pa.array(numbers(row, c, t).astype(u)) for c, t, u in (("lengths", np.uint32, np.int64), ("known", np.int64, np.int64), ("base", float, float), ("done", float, float))]]
            return pa.table(columns, ["row", "n_tokens", "n_known", "base_score", "score"])

        scored = self.table(state).select("rows", "lengths", "known", "base", "done").mapInArrow(each_row(use), f"row {rows}, n_tokens long, n_known long, base_score double, score double")
        return scored.select("row.*", "n_tokens", "n_known", F.lit(int(self.rules.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def score_documents(docs: DataFrame, rules: Rules | None = None, block_tokens: int = 250_000, bucket_keys: int = 500_000) -> DataFrame:
    """Per row of `docs` (text, teaches and the columns it has besides): those columns and n_tokens, n_known, train_tokens, base_score, score."""
    kept = ", ".join(f"{c}: {t}" for c, t in docs.dtypes if c not in ("text", "teaches"))
    with freed_shuffles(docs.sparkSession):
        rounds = Rounds(docs, rules or Rules(), block_tokens, bucket_keys)
        try:
            return checkpoint(rounds.scores(rounds.run(), f"struct<{kept}>"))
        finally:
            rounds.drop()


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(read_table(spark, sf_dir, "documents"))
    held_out = fold_of(F.col("doc_id"), 7) == 2
    return score_documents(docs.select("doc_id", held_out.alias("held_out"), "text", (~held_out).alias("teaches")))

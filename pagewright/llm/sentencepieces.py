"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

A document's ids are the best path through a lattice of tokens. In a unigram
model an edge has its token's score. A BPE segmentation is the only one in
which every two neighbouring tokens are what BPE makes of their concatenation,
so that its edges score 0 (neighbours agree) or minus infinity.

A giant document is cut into chunks; the tokens that can reach over a cut are
its boundary states, and each chunk yields the max-plus transfer matrix between
its two cuts. Matrices combine associatively: FAN neighbours at a time become
one, level by level, in parallel tasks; from the top, the best states at the
inner cuts of each group follow from those at its ends. With the states known
at both ends each chunk is traced back by itself. Where no piece can reach over
a place (a space after a non-space), all paths meet, so that only the ends of a
chunk need the lattice; what lies between adds the same score to all of them
and is left to the library.

Decoding works on the same chunks.

Defined cases: null text is the empty text and has no ids; ids equal the
library's for the whole text at any length (but for paths of a unigram model
whose scores differ by less than float32 can tell); U+2581 decodes to a space,
as in the library; repeated rows and null ids give a row each. Models other
than unigram and BPE, those that change texts before splitting them (but for
spaces and the space before the text), and those without byte fallback are
refused with ValueError.
"""

from __future__ import annotations

import functools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_CHARS = 1 << 14
#: Ids that the library decodes at once, and matrices that a task combines.
IDS_AT_ONCE, FAN = 1 << 16, 256
SPACE = "▁"
#: Fixed value: how much worse than the worst piece an unknown character scores in a unigram model.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a protocol buffer's fields; messages and strings as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def checked(model: bytes) -> bool:
    """Whether a model is a unigram model; ValueError if it is neither that nor BPE, or changes texts."""
    found = dict(fields(model))
    trainer, normalizer = dict(fields(found.get(2, b""))), dict(fields(found.get(3, b"")))
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("models that change texts, or spaces beyond the one before the text, are not supported")
    if not trainer.get(35, 0):
        raise ValueError("models without byte fallback are not supported")
    return trainer.get(3, 1) == 1


class Pieces:
    """A model: the library's processor, and what the lattice needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.unigram = checked(model)
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = range(lib.get_piece_size())
        self.ids = {lib.id_to_piece(i): i for i in size if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.agreed: dict[tuple[str, str], bool] = {}
        self.bytes = np.array([lib.is_byte(i) for i in size])
        self.anchor = next(i for p, i in self.ids.items() if SPACE not in p)

    def edge(self, before: str, token: str) -> float:
        """Score of a token behind another one ("": the text's start, or any)."""
        if self.unigram:
            return self.scores.get(token, self.unknown)
        return 0.0 if self.agree(before, token) else -np.inf

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: join the best-scored pair, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        """May token b follow token a? "" stands for either end of the text."""
        found = self.agreed.get((a, b))
        if found is None:
            if len(self.agreed) > 500_000:
                self.agreed.clear()
            found = self.agreed[a, b] = self.merge(a + b) == [x for x in (a, b) if x]
        return found

    def starting(self, text: str, at: int) -> list[str]:
        """The tokens that can stand at a place: pieces, or a single character."""
        return [t for n in range(1, min(self.longest, len(text) - at) + 1) if (t := text[at : at + n]) in self.scores or n == 1]

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of ids, some at a time; first: they start the document, so that the space before it goes."""
        out, at, anchor = [], 0, self.lib.id_to_piece(self.anchor)
        while at < len(ids):
            stop = min(len(ids), at + IDS_AT_ONCE)
            while stop < len(ids) and self.bytes[ids[stop]]:  # bytes of one character stay together
                stop += 1
            part = ids[at:stop].tolist()
            out.append(self.lib.decode(part) if first and not at else self.lib.decode([self.anchor, *part])[len(anchor) :])
            at = stop
        return "".join(out)

    def ids_of(self, token: str) -> list[int]:
        if token in self.ids:
            return [self.ids[token]]
        return [self.lib.piece_to_id(f"<0x{b:02X}>") for b in token.encode()]

    def encode_whole(self, text: str) -> list[int]:
        """The library's ids of a normalised text that starts with SPACE."""
        return self.lib.encode(text[1:]) if len(text) > 1 else [self.ids[SPACE]]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def states_at(p: Pieces, text: str, cut: int) -> list[tuple[int, int]]:
    """(start, end) of the tokens with start < cut <= end; text is the surroundings of the cut."""
    return [(s, s + len(t)) for s in range(max(0, cut - p.longest), cut) for t in p.starting(text, s) if s + len(t) >= cut]


class Chunk:
    """text[low:high] is the chunk's own, the rest is margin; low is 0 for the first chunk, high the end for the last one."""

    def __init__(self, p: Pieces, text: str, low: int, high: int, first: bool, last: bool):
        self.p, self.text, self.low, self.high = p, text, low, high
        self.entries = [(-1, low)] if first else states_at(p, text, low)
        self.exits = [(high, -1)] if last else states_at(p, text, high)
        self.last = last
        if p.splits:
            places = [i for i in range(low + 1, min(high, low + 1 + 4096)) if self.meets(i)][:1]
            self.head = places[0] if places else None
            tail = next((i for i in range(high - 1, (self.head or high), -1) if self.meets(i)), None) if places else None
            self.tail = tail if tail is not None else self.head
        else:
            self.head = self.tail = None

    def meets(self, i: int) -> bool:
        return self.text[i] == SPACE and self.text[i - 1] != SPACE

    def name(self, state: tuple[int, int]) -> str:
        return self.text[state[0] : state[1]] if state[0] >= 0 and state[1] >= 0 else ""

    def paths(self, starts: dict[tuple[int, int], int], stop: int, free: bool):
        """Walk the lattice from states to the place stop.

        Returns {state: {start: (score, previous state)}}, the best path from
        each start, for the states that end at stop (free: any token may come
        last there) or that reach to or over it; then the same for those before.
        """
        nodes: dict[int, dict[tuple[int, int], dict[int, tuple]]] = {}
        done: dict[tuple[int, int], dict[int, tuple]] = {}
        for state, i in starts.items():
            where = done if state[1] >= stop else nodes.setdefault(state[1], {})
            where.setdefault(state, {})[i] = (0.0, None)
        back = {}
        at = min(nodes, default=stop)
        while at < stop:
            here = nodes.pop(at, None)
            if here:
                options = self.p.starting(self.text, at)
                for state, origins in here.items():
                    back[state] = origins
                    before = self.name(state) if state[0] >= 0 else ""
                    for t in options:
                        end = at + len(t)
                        if free and end > stop or (gain := self.p.edge(before, t)) == -np.inf:
                            continue
                        slot = (done if end >= stop else nodes.setdefault(end, {})).setdefault((at, end), {})
                        for i, (score, _) in origins.items():
                            if i not in slot or score + gain > slot[i][0]:
                                slot[i] = (score + gain, state)
            at += 1
        return done, back

    def trace(self, state, i: int, done, back) -> list[int]:
        """The ids of the tokens from start i to a reached state, without the start itself."""
        tokens, origins = [], done[state]
        while (previous := origins[i][1]) is not None:
            tokens.append(state)
            state, origins = previous, back[previous]
        return [x for t in reversed(tokens) for x in self.p.ids_of(self.name(t))]

    def starts(self) -> dict[tuple[int, int], int]:
        return {s: i for i, s in enumerate(self.entries)}

    def ends(self, done: dict) -> dict[tuple[int, int], dict]:
        """What counts as an exit: at the end of the document, whatever ends there."""
        return {s: x for s, x in done.items() if not self.last or s[1] == self.high}

    def first_part(self):
        return self.paths(self.starts(), self.high if self.head is None else self.head, self.head is not None or self.last)

    def last_part(self):
        return self.paths({(-1, self.tail): 0}, self.high, self.last)

    def matrix(self) -> np.ndarray:
        """[entry, exit]: the best score of a path between them, less what all paths share; minus infinity if there is none."""
        number = {s: 0 if self.last else j for j, s in enumerate(self.exits)}
        out = np.full((len(self.entries), len(self.exits)), -np.inf)

        def best(found, rows):
            for state, origins in self.ends(found).items():
                j = 0 if self.last else number[state]
                for i, (score, _) in origins.items():
                    rows[i, j] = max(rows[i, j], score)
            return rows

        done, _ = self.first_part()
        if self.head is None:
            return best(done, out)
        enter = np.full(len(self.entries), -np.inf)
        for origins in done.values():
            for i, (score, _) in origins.items():
                enter[i] = max(enter[i], score)
        return enter[:, None] + best(self.last_part()[0], out[:1].copy())

    def ids(self, entry: int, exit_: int) -> list[int]:
        """The ids of the tokens that start in this chunk, given the states at both of its cuts."""
        goal = self.exits[exit_]

        def finish(done, i):
            reached = [s for s, x in self.ends(done).items() if i in x and (self.last or s == goal)]
            return max(reached, key=lambda s: done[s][i][0])

        done, back = self.first_part()
        if self.head is None:
            return self.trace(finish(done, entry), entry, done, back)
        at_head = max((s for s, x in done.items() if entry in x), key=lambda s: done[s][entry][0])
        out = self.trace(at_head, entry, done, back)
        if self.tail > self.head:
            out += self.p.encode_whole(self.text[self.head : self.tail])
        done, back = self.last_part()
        return out + self.trace(finish(done, 0), 0, done, back)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


def states_of(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[int]:
    """The states at the cuts of a best path from entry to leave, both included; of equal ones the first."""
    ahead = [np.where(np.arange(matrices[0].shape[0]) == entry, 0.0, -np.inf)] if matrices else []
    for m in matrices[:-1]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    states = [leave]
    for before, m in zip(reversed(ahead), reversed(matrices), strict=True):
        states.append(int(np.argmax(before + m[:, states[-1]])))
    return states[::-1]


def cut_up(text: str, longest: int, chunk_chars: int) -> list[tuple[str, int, int, bool, bool]]:
    """What Chunk takes, for each chunk of a normalised text."""
    n = len(text)
    if not n:
        return []
    cuts = [*range(0, n, chunk_chars)]
    if len(cuts) > 1 and n - cuts[-1] < 2 * longest + 2:
        cuts.pop()
    out = []
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        low, high = max(0, a - longest), min(n, b + longest)
        out.append((text[low:high], a - low, b - low, a == 0, b == n))
    return out


def encode_chunked(text: str, model: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """The scan on one machine, as the DataFrame operator runs it."""
    p = pieces(model)
    chunks = [Chunk(p, *x) for x in cut_up(normalised(text), p.longest, chunk_chars)]
    states = states_of([c.matrix() for c in chunks])
    return [x for c, i, j in zip(chunks, states, states[1:], strict=False) for x in c.ids(i, j)]


_CHUNK = "piece string, low int, high int, first boolean, last boolean"
_MATRIX = "doc_row bigint, chunk int, n_in int, matrix binary"
_STATES = "doc_row bigint, chunk int, entry int, leave int"


def _matrices(table: pa.Table) -> list[np.ndarray]:
    """In the order of their chunks, by which the table is sorted."""
    return [np.frombuffer(m).reshape(n, -1) for m, n in zip(table.column("matrix").to_pylist(), table.column("n_in").to_pylist(), strict=True)]


def states_between(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """doc_row, chunk, entry, leave: the states at both cuts of each chunk. matrices: stored, of each document's chunks from 0 to at most `most`."""

    def product(key, table):
        table = table.sort_by("chunk")
        m = functools.reduce(combine, _matrices(table))
        return pa.table({"doc_row": table.column("doc_row").slice(0, 1), "chunk": pa.array([key[1].as_py()], pa.int32()), "n_in": pa.array([len(m)], pa.int32()), "matrix": pa.array([m.tobytes()])})

    def between(table):
        table = table.sort_by("chunk")
        ends = (table.column(c)[0].as_py() for c in ("entry", "leave"))
        states = states_of(_matrices(table), *ends)
        return pa.table({"doc_row": table.column("doc_row"), "chunk": table.column("chunk"), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})

    group = F.expr(f"cast(chunk div {fan} as int)")
    levels = [matrices]
    while most >= fan:
        above = levels[-1].withColumn("up", group).groupBy("doc_row", "up").applyInArrow(product, _MATRIX)
        levels.append(common.stored(above, "matrices"))
        most //= fan
    states = None
    for level in reversed(levels):
        rows = level.withColumn("up", group)
        if states is None:
            rows = rows.withColumns({"entry": F.lit(0), "leave": F.lit(0)})
        else:
            rows = rows.join(states.withColumnRenamed("chunk", "up"), ["doc_row", "up"])
        states = rows.groupBy("doc_row", "up").applyInArrow(lambda t: between(t), _STATES)
    return states


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """id, doc_row, chunk, ids array<int>, giant: the ids of a row of df are those of its doc_row by chunk; only giant texts have several."""
    model = model or default_model()
    if chunk_chars < 64:
        raise ValueError("chunks must have 64 characters at least")
    src = common.small_batches(common.with_text(df, [id_col], text_col).withColumn("doc_row", F.monotonically_increasing_id()))
    fields = "doc_row bigint, chunk int, ids array<int>"
    schema = common.out_schema(src, [id_col], fields)
    chunk_schema = common.out_schema(src, [id_col], "doc_row bigint, chunk int, " + _CHUNK)

    def short(batches):
        lib = pieces(model).lib
        for piece, texts in common.slices(batches, 1 << 20):
            found = lib.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)
            yield common.arrow_batch(schema, [piece.column(id_col), piece.column("doc_row"), [0] * len(piece), found])

    def split(batches):
        p = pieces(model)
        for piece, texts in common.slices(batches):
            for i, t in enumerate(texts):
                parts = cut_up(normalised(t.decode("utf-8", "replace")), p.longest, chunk_chars)
                take = pa.array([i] * len(parts), type=pa.int64())
                yield common.arrow_batch(chunk_schema, [piece.column(id_col).take(take), piece.column("doc_row").take(take), list(range(len(parts))), *map(list, zip(*parts, strict=True))])

    def rows_of(batch):
        names = ("piece", "low", "high", "first", "last")
        return zip(*(batch.column(n).to_pylist() for n in names), strict=True)

    def transfer(batches):
        p = pieces(model)
        for batch in batches:
            found = [Chunk(p, *x).matrix() for x in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_row"), batch.column("chunk"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["doc_row", "chunk", "n_in", "matrix"])

    def trace(batches):
        p = pieces(model)
        for batch in batches:
            states = zip(batch.column("entry").to_pylist(), batch.column("leave").to_pylist(), strict=True)
            found = [Chunk(p, *x).ids(*s) for x, s in zip(rows_of(batch), states, strict=True)]
            yield common.arrow_batch(schema, [batch.column(id_col), batch.column("doc_row"), batch.column("chunk"), found])

    giant = F.length("__text") > chunk_chars
    # Files of few chunks, which tasks share out without a shuffle.
    chunks = common.stored(src.where(giant).mapInArrow(split, chunk_schema), "chunks", rows_per_file=512).select(id_col, "doc_row", "chunk", "piece", "low", "high", "first", "last")
    matrices = common.stored(chunks.mapInArrow(transfer, _MATRIX), "matrices")
    most = matrices.agg(F.max("chunk")).collect()[0][0]
    states = common.stored(states_between(matrices, most or 0, fan), "states")  # of known size when the join is planned
    traced = chunks.join(states, ["doc_row", "chunk"]).mapInArrow(trace, schema)
    return src.where(~giant).mapInArrow(short, schema).withColumn("giant", F.lit(False)).unionByName(traced.withColumn("giant", F.lit(True)))


def whole(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, ids (and text, if decode_chunks() has added it): one row per text from the chunks that encode() gives; only those of giant texts are shuffled."""
    texts = "text" in encoded.columns
    several = encoded.where("giant").groupBy(id_col, "doc_row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", *(["text"] if texts else [])))).alias("c"))
    joined = [F.array_join("c.text", "").alias("text")] if texts else []
    return encoded.where("not giant").select(id_col, "ids", *(["text"] if texts else [])).unionByName(several.select(id_col, F.flatten("c.ids").alias("ids"), *joined))


def _text_of(model: str):
    def run(ids: pa.Array, chunk: pa.Array) -> pa.Array:
        p = pieces(model)
        return pa.array([p.decode(x.values.to_numpy(zero_copy_only=False), not k) if x.is_valid else "" for x, k in zip(ids, chunk.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")


def decode_chunks(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encode()'s rows with the text of each chunk."""
    return common.small_batches(encoded).withColumn("text", _text_of(model or default_model())("ids", "chunk"))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id, text; null ids count as none and give the empty text."""
    return common.small_batches(df).select(F.col(id_col), _text_of(model or default_model())(F.col(ids_col), F.lit(0)).alias("text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as decimal numbers, comma-joined), and n_chars and text_sha256 of the decoded text."""
    found = whole(decode_chunks(encode(common.table(spark, sf_dir, "documents"))))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))

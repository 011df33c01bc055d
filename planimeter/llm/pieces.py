"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The lattice of a text, with one space put before it, holds every vocabulary piece that stands between its
characters, and byte pieces for characters no piece covers. Forward filtering sums the probabilities of
all paths to each node; backward sampling then draws a path from the end, piece by piece, exactly in
proportion to its probability. A node that no piece of the vocabulary can cross (its two characters are
neighbours in none) lies on every path, so the lattice falls into chunks there and is still the whole text's: filtering
and sampling chunk by chunk give the distribution of the whole lattice, however long a chunk is. Each draw
is a hash of the row's key, the chunk's place and the step, so a row's segmentation is the same in any run and
on any executor.

Chunks repeat, so each distinct chunk of a pass is filtered once for many occurrences, and all occurrences
are sampled together by array operations; filtering works in logarithms, so long chunks do not underflow. A
piece's probability falls with its rank in the model's merge order (Zipf-Mandelbrot); paths are drawn in
proportion to their probability to the power `sharpness`. A pass holds about PASS_CHARS characters: a longer
text goes through several, cut between chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from planimeter.llm.common import small_batches, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Shift of the Zipf-Mandelbrot rule; characters of one array pass.
SHIFT, PASS_CHARS = 1000.0, 400_000

HASH = np.uint64(0x9E3779B97F4A7C15)


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(HASH) + ord(c)) % 2**64
    return h


class Vocabulary:
    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        texts: list[bytes] = [b""] * self.size
        self.byte_id = [-1] * 256
        weights = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                texts[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                surface = piece.replace(MARK, " ")
                texts[i] = surface.encode()
                weights[surface] = (i, 1 / (SHIFT - sp.get_score(i)))
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces, so texts could not always be restored")
        total = sum(w for _, w in weights.values())
        self.pieces = {s: (i, (w / total) ** sharpness) for s, (i, w) in weights.items()}
        self.longest = max(map(len, self.pieces))
        #: By length: sorted hashes of the pieces' prefixes, and the piece (or -1) and chance of each.
        self.prefixes = {}
        for n in range(1, self.longest + 1):
            known = {s[:n] for s in self.pieces if len(s) >= n}
            rows = sorted((_hash(s), *self.pieces.get(s, (-1, 0.0))) for s in known)
            self.prefixes[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows]))
        #: Of a character only bytes cover: less likely than any piece.
        self.fallback = min(p for _, p in self.pieces.values()) / 10
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        #: Numbers of the characters of longer pieces (0: in none), and which two stand side by side in a piece.
        letters = {c: i for i, c in enumerate(sorted({c for s in self.pieces if len(s) > 1 for c in s}), 1)}
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.joined = np.zeros((len(letters) + 1) ** 2, bool)
        self.letters = len(letters) + 1
        for piece in self.pieces:
            for x, y in zip(piece, piece[1:], strict=False):
                self.joined[letters[x] * self.letters + letters[y]] = True

    def cuts(self, text: str) -> np.ndarray:
        """Places inside a text that no piece can cross."""
        kinds = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        return np.flatnonzero(~self.joined[kinds[:-1] * self.letters + kinds[1:]]) + 1


@lru_cache(2)
def vocabulary(model: str, sharpness: float) -> Vocabulary:
    out = Vocabulary(model, sharpness)
    trim()
    return out


class Lattices:
    """Filtered lattices of distinct chunks, as flat arrays of arcs grouped by the node they end in.

    Chunk k has a node before each character and one at its end. Pieces are found by walking all
    characters of all chunks at once, a letter further at each step, through the sorted hashes of the
    prefixes of pieces; what is no prefix any more stops."""

    def __init__(self, v: Vocabulary, chunks: list[str]):
        sizes = np.fromiter(map(len, chunks), np.int32, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes, dtype=np.int32)
        self.first = ends - sizes + np.arange(len(chunks), dtype=np.int32)
        self.last = self.first + sizes
        of = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(ends - sizes, sizes)
        at, left, h = np.arange(len(codes), dtype=np.int32), np.repeat(sizes, sizes) - place, np.zeros(len(codes), np.uint64)
        starts, lengths, pieces, chances = [], [], [], []
        lone = np.ones(len(codes), bool)
        for n in range(1, v.longest + 1):
            h = h * HASH + codes[at + (n - 1)]
            known, ids, chance = v.prefixes[n]
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            on = known[k] == h
            at, left, h, k = at[on], left[on], h[on], k[on]
            hit = ids[k] >= 0
            if n == 1:
                lone[at[hit]] = False
            starts.append(at[hit])
            lengths.append(np.full(len(starts[-1]), n, np.int32))
            pieces.append(ids[k[hit]])
            chances.append(chance[k[hit]])
            on = left > n
            at, left, h = at[on], left[on], h[on]
        # Characters only bytes cover: a piece number of their own beyond the model's.
        bare = np.flatnonzero(lone)
        self.rare, which = np.unique(codes[bare], return_inverse=True)
        starts.append(bare.astype(np.int32))
        lengths.append(np.ones(len(bare), np.int32))
        pieces.append((v.size + which.reshape(-1)).astype(np.int32))
        chances.append(np.full(len(bare), v.fallback))
        # The longest pieces first: they are likeliest, and sampling looks from the front.
        start, length, piece, chance = (np.concatenate(x[::-1]) for x in (starts, lengths, pieces, chances))
        end_place = place[start] + length
        source = start + of[start]
        end = source + length
        order = np.argsort(end, kind="stable")
        order = order[np.argsort(end_place[order], kind="stable")]
        source, end, piece, end_place = source[order], end[order], piece[order], end_place[order]
        chance = np.log(chance[order])
        self.source, self.piece = source, piece
        alpha = np.zeros(int(ends[-1]) + len(chunks) if len(chunks) else 0)  # logarithms
        self.mass = np.empty(len(source))
        self.at = np.zeros(len(alpha), np.int32)  # a node's first arc
        cuts = np.searchsorted(end_place, np.arange(int(end_place[-1]) + 2 if len(end_place) else 1))
        rank = np.empty(len(source), np.int32)
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            if a == b:
                continue
            weight = alpha[source[a:b]] + chance[a:b]
            new = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            top = np.maximum.reduceat(weight, new)
            size = np.diff(new, append=b - a)
            weight = np.exp(weight - np.repeat(top, size))
            total = np.add.reduceat(weight, new)
            alpha[end[a:b][new]] = top + np.log(total)
            self.mass[a:b] = weight / np.repeat(total, size)
            rank[a:b] = np.arange(b - a, dtype=np.int32) - np.repeat(new, size)
            self.at[end[a:b][new]] = a + new
        # Shares of a node's arcs summed from its first, each node by itself; the last arc takes what is left.
        for k in range(1, int(rank.max(initial=0)) + 1):
            x = np.flatnonzero(rank == k)
            self.mass[x] += self.mass[x - 1]
        self.mass[np.flatnonzero(np.append(rank[1:], 0) == 0)] = 2.0


def _draw(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from seeds and a step."""
    x = seed + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


class Encoder:
    """Encodes many texts at a time; which texts go together never changes a result."""

    def __init__(self, model: str = MODEL, sharpness: float = 0.5, seed: int = 4):
        self.v = vocabulary(model, sharpness)
        self.seed = seed

    def _row_seed(self, key, text: str) -> int:
        name = f"k{key}" if key is not None else f"t{xxhash.xxh64_intdigest(text.encode('utf-8', 'surrogatepass'))}"
        return xxhash.xxh64_intdigest(name, self.seed)

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """Texts with a space before them (empty ones without), by row; long ones in parts that no piece crosses."""
        for i, text in enumerate(texts):
            text = " " + text if text else ""
            start, size = 0, PASS_CHARS
            while len(text) - start > size:
                cuts = self.v.cuts(text[start : start + size])
                if len(cuts):
                    yield i, text[start : start + int(cuts[-1])]
                    start, size = start + int(cuts[-1]), PASS_CHARS
                else:
                    size *= 2
            yield i, text[start:]

    def passes(self, keys: list, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows in their order as first, end, piece ids end to end, where each row's begin (one more entry than
        rows), and whether each row's ids spell its text."""
        seeds = [self._row_seed(k, t) for k, t in zip(keys, texts, strict=True)]
        held: list[tuple[np.ndarray, int, bool]] = []  # of a row whose parts are not all done: ids, chunks, lossless
        first = 0
        work: list[tuple[int, str]] = []
        size = 0

        def flush(ends: bool):
            nonlocal held, first, work, size
            chunks_before = sum(c for _, c, _ in held)
            ids, bounds, counts, same = self._encode_parts(work, seeds, first, chunks_before)
            last = work[-1][0] + ends  # more of the last row may follow
            rows = np.array([r for r, _ in work if r < last], np.int64) - first
            whole = len(rows)
            n = np.bincount(rows, np.diff(bounds)[:whole], minlength=last - first).astype(np.int64)
            fine = np.ones(last - first, bool)
            np.logical_and.at(fine, rows, same[:whole])
            out = None
            if last > first:
                early = [x for x, _, _ in held]
                n[0] += sum(map(len, early))
                fine[0] &= all(f for _, _, f in held)
                out = first, last, np.concatenate([*early, ids[: bounds[whole]]]), np.concatenate([[0], np.cumsum(n)]), fine
                held = []
            if not ends:
                held.append((ids[bounds[whole] :], int(counts[whole:].sum()), bool(same[whole:].all())))
            first, work, size = last, [], 0
            return out

        for i, part in self._parts(texts):
            work.append((i, part))
            size += len(part)
            if size >= PASS_CHARS and (out := flush(False)):
                yield out
        if work and (out := flush(True)):
            yield out
        elif held:
            early = [x for x, _, _ in held]
            yield first, first + 1, np.concatenate(early), np.array([0, sum(map(len, early))]), np.array([all(f for _, _, f in held)])

    def encode(self, keys: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and where each text's begin (one more entry than texts)."""
        done = list(self.passes(keys, texts))
        ids = np.concatenate([np.zeros(0, np.int32), *[x[2] for x in done]])
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(x[3]) for x in done]]))])

    def _encode_parts(self, work: list[tuple[int, str]], seeds: list[int], first_row: int, chunks_before: int):
        """Ids of parts end to end, where each part's begin, its chunks, and whether its ids spell it."""
        sizes = np.array([len(p) for _, p in work], np.int64)
        ends = np.cumsum(sizes)
        text = "".join(p for _, p in work)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(work) + 1, np.int64), np.zeros(len(work), np.int64), np.ones(len(work), bool)
        cuts = np.union1d(self.v.cuts(text), np.concatenate([[0], ends]))
        counts = np.diff(np.searchsorted(cuts, np.concatenate([[0], ends])))
        n = len(cuts) - 1
        bounds = cuts.tolist()
        found = [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        known = dict.fromkeys(found)
        known = dict(zip(known, range(len(known)), strict=True))
        chunk = np.fromiter(map(known.__getitem__, found), np.int32, n)
        del found, bounds
        lat = Lattices(self.v, list(known))
        del known
        before = np.cumsum(counts) - counts
        rows = np.array([r for r, _ in work], np.int64)
        # A row's chunks count on from its earlier parts, in this pass or the ones before.
        base = before[np.searchsorted(rows, rows)]
        base[rows == first_row] -= chunks_before
        place = np.arange(n) - np.repeat(base, counts)
        seed = np.repeat(np.array([seeds[r] for r, _ in work], np.uint64), counts) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = lat.first[chunk]
        steps, active, node, sizes, step = [], np.arange(n, dtype=np.int32), lat.last[chunk], np.zeros(n, np.int32), 0
        while len(active):
            arc, u = lat.at[node], _draw(seed, step)
            look = np.flatnonzero(u >= lat.mass[arc])
            while len(look):
                arc[look] += 1
                look = look[u[look] >= lat.mass[arc[look]]]
            steps.append((active, lat.piece[arc]))
            sizes[active] += 1
            node = lat.source[arc]
            on = node > first
            active, node, first, seed, step = active[on], node[on], first[on], seed[on], step + 1
        offset = np.cumsum(sizes, dtype=np.int64)
        ids = np.empty(int(offset[-1]), np.int32)
        for k, (who, what) in enumerate(steps):
            ids[offset[who] - 1 - k] = what
        del steps
        places = np.concatenate([[0], offset])
        ids, bounds = self._bytes_for_rare(ids, places[np.concatenate([[0], np.cumsum(counts)])], lat.rare)
        spelled = self.decode(ids)
        if spelled == text.encode("utf-8", "surrogatepass"):
            return ids, bounds, counts, np.ones(len(work), bool)
        same = [self.decode(ids[a:b]) == p.encode("utf-8", "surrogatepass") for (_, p), a, b in zip(work, bounds, bounds[1:], strict=False)]
        return ids, bounds, counts, np.array(same)

    def _bytes_for_rare(self, ids: np.ndarray, bounds: np.ndarray, rare_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rare = ids >= self.v.size
        if not rare.any():
            return ids, bounds
        spelled = [[self.v.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in rare_codes]
        width = np.ones(len(ids), np.int64)
        at = np.flatnonzero(rare)
        width[at] = [len(spelled[k]) for k in ids[at] - self.v.size]
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        for a, k in zip(ends[at], ids[at] - self.v.size, strict=True):
            out[a : a + len(spelled[k])] = spelled[k]
        return out, ends[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that piece ids spell, the space put before each text included."""
        lengths = self.v.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        return self.v.flat[np.repeat(self.v.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


def decode_ids(ids, model: str = MODEL) -> str:
    """The text that one row's piece ids encode; no ids: an empty text."""
    raw = Encoder(model).decode(np.array(ids, np.int64)) if len(ids) else b" "
    return raw[1:].decode("utf-8", "surrogatepass")


def _encode(model: str, sharpness: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, sharpness, seed)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b, ids, bounds, lossless in encoder.passes(keys, texts):
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                        "n_pieces": pa.array(np.diff(bounds), pa.int64()),
                        "lossless": pa.array(lossless, pa.bool_()),
                    }
                )
            trim()

    return run


def encode_pieces(df: DataFrame, *, id_col="doc_id", text_col="text", model=MODEL, sharpness=0.5, seed=4) -> DataFrame:
    """One row a document: doc_id, ids (its sampled pieces), n_pieces, lossless (ids decode to the text).

    Null and empty texts have no pieces (a null text therefore decodes as empty). Rows with a null key are
    seeded by their text; rows that repeat a key and a text get the same pieces. An empty table gives no
    rows; other columns are not read. model is a path each executor can open."""
    small_batches(df.sparkSession)
    schema = "doc_id long, ids array<int>, n_pieces long, lossless boolean"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(model, sharpness, seed), schema)


def decode_pieces(df: DataFrame, *, ids_col="ids", model=MODEL) -> DataFrame:
    """df with a column text decoded from ids (null ids: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else encoder.decode(np.array(x, np.int64))[1:].decode("utf-8", "surrogatepass") for x in found]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    if "text" in df.columns:
        raise ValueError("the table already has a column text")
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("text", StringType())]))

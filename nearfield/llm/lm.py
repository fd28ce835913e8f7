"""Language-model scoring by interpolated modified Kneser-Ney.

Spark counts, and workers look up: words are counted first and stored as arrays sorted by hash,
which also number them. Pairs of such numbers are counted next, in shards, and stored as sorted
arrays too. Workers memory-map the arrays and find the pairs of a batch of texts by binary search.
Counts travel as compressed sorted blocks, one row per shard and batch.

The model is of order 2: ``P(w|v) = (c(v,w) - D(c)) / c(v) + g(v) P(w)``, where ``P(w)`` is the
same form over the number of different words before ``w``, interpolated with the uniform
distribution over all words and one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import scratch, written
from nearfield.llm.files import mapped, own_file, save

# Words of one vocabulary file, and tokens behind one file of pairs.
SHARD_WORDS = 2_000_000
SHARD_TOKENS = 8_000_000
# Text bytes that are cut into words at a time, and pairs that are counted at a time.
CHUNK_BYTES = 4 << 20
CHUNK_PAIRS = 3_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END = b"\n"  # no word: it is white space
_U = np.uint64


def _bodies(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def _chunks(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, body in enumerate(bodies):
        size += len(body)
        if size >= CHUNK_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(bodies):
        yield begin, len(bodies)


def tokenise(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (ascending), the tokens as their places, tokens per text."""
    words: list[bytes] = []
    sizes = np.zeros(len(bodies), np.int64)
    for i, body in enumerate(bodies):
        own = body.translate(_LOWER).split()
        words += own
        words.append(_END)
        sizes[i] = len(own) + 1
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], place[ids], sizes


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    if not len(keys):
        return keys, counts
    return keys[starts], np.add.reduceat(counts, starts)


# Words --------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def flushed():
        k, c = _added(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(k.view(np.int64)), pa.array(c)], ["word", "count"]
        )

    for batch in batches:
        bodies = _bodies(batch.column("text"))
        for a, b in _chunks(bodies):
            hashes, ids, _ = tokenise(bodies[a:b])
            keys.append(hashes)
            counts.append(np.bincount(ids, minlength=len(hashes)))
            held += len(hashes)
            if held > CHUNK_PAIRS:
                yield flushed()
                keys, counts, held = [], [], 0
    if keys:
        yield flushed()


@dataclass
class Vocabulary:
    """Words as numbers: files of sorted hashes, by equal parts of the hash range."""

    hashes: list[str]
    counts: list[str]
    firsts: list[int]
    size: int
    tokens: int

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _U(32)) * _U(len(self.hashes))) >> _U(32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted hashes."""
        numbers = np.full(len(hashes), -1, np.int64)
        counts = np.zeros(len(hashes), np.int64)
        parts = self.part_of(hashes)
        for part in np.unique(parts):
            own = slice(*np.searchsorted(parts, [part, part + _U(1)]))
            keys = mapped(self.hashes[part])
            at = np.minimum(np.searchsorted(keys, hashes[own]), max(len(keys) - 1, 0))
            known = keys[at] == hashes[own] if len(keys) else np.zeros(len(at), bool)
            numbers[own] = np.where(known, self.firsts[part] + at, -1)
            if len(keys):
                counts[own] = np.where(known, mapped(self.counts[part])[at], 0)
        return numbers, counts


def count_words(texts: DataFrame, folder: str, shard_words: int = SHARD_WORDS) -> Vocabulary:
    counted = written(
        texts.mapInArrow(_word_counts, "word bigint, count bigint").groupBy("word").agg(
            F.sum("count").alias("count")
        ),
        "lm-words",
    )
    row = counted.agg(F.count("word").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("t")).first()
    parts = max(1, -(-row["n"] // shard_words))
    part = F.shiftrightunsigned(F.shiftrightunsigned("word", 32) * parts, 32)

    def store(rows: pa.Table) -> pa.Table:
        words = rows.column("word").to_numpy().view(_U)
        order = np.argsort(words)
        return pa.table(
            {
                "part": rows.column("part")[:1],
                "n": [len(order)],
                "hashes": [save(own_file(folder, "words", "npy"), words[order])],
                "counts": [
                    save(own_file(folder, "counts", "npy"), rows.column("count").to_numpy()[order])
                ],
            }
        )

    files = (
        counted.withColumn("part", part)
        .groupBy("part")
        .applyInArrow(store, "part bigint, n bigint, hashes string, counts string")
    )
    found = {row["part"]: row for row in written(files, "lm-word-files").collect()}
    empty = [save(own_file(folder, "none", "npy"), np.zeros(0, t)) for t in (_U, np.int64)]
    sizes = [found[i]["n"] if i in found else 0 for i in range(parts)]
    return Vocabulary(
        [found[i]["hashes"] if i in found else empty[0] for i in range(parts)],
        [found[i]["counts"] if i in found else empty[1] for i in range(parts)],
        np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist(),
        row["n"],
        int(row["t"]),
    )


# Pairs --------------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Sorted keys as gaps, and their counts, compressed."""
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(block: bytes, *types: type) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n, at))
        at += size
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _shard(before: np.ndarray, after: np.ndarray, weight: np.ndarray, shards: int, words: int, tokens: int):
    """Shard of a pair: by the first word, and by ranges of the second where the first is frequent."""
    spread = weight // tokens + 1
    mixed = (before.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)
    return ((mixed.astype(np.int64) + after * spread // max(words, 1)) % shards).astype(np.int32)


def pairs_of(ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before every token (``start`` before the first of a text), and the token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return before, ids


def _pair_blocks(words: Vocabulary, shards: int, texts: int, shard_tokens: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0

        def flushed():
            key = np.concatenate(keys)
            order = np.argsort(key)
            key, weight = key[order], np.concatenate(weights)[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(key)]])).astype(np.uint32)
            key = key[starts]
            part = _shard(key >> 32, key & 0xFFFFFFFF, weight[starts], shards, words.size, shard_tokens)
            by_part = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by_part], np.arange(shards + 1))
            found = [i for i in range(shards) if edges[i] < edges[i + 1]]
            blocks = [by_part[edges[i] : edges[i + 1]] for i in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int32()),
                    pa.array([_packed(_gaps(key[b]), counts[b]) for b in blocks], pa.binary()),
                ],
                ["shard", "block"],
            )

        for batch in batches:
            bodies = _bodies(batch.column("text"))
            for a, b in _chunks(bodies):
                hashes, ids, sizes = tokenise(bodies[a:b])
                numbers, counts = words.look_up(hashes)
                # The start of a text is a word of its own behind all others.
                numbers, counts = np.append(numbers, words.size), np.append(counts, texts)
                before, after = pairs_of(ids, sizes, len(hashes))
                keys.append((numbers[before] << 32) | numbers[after])
                weights.append(counts[before])
                held += len(ids)
                if held > CHUNK_PAIRS:
                    yield flushed()
                    keys, weights, held = [], [], 0
        if keys:
            yield flushed()

    return count


_STORED = "shard int, pairs string, counts string, distinct bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, part int, block binary"


def _stored_pairs(folder: str, part_words: int):
    """Merge the blocks of a shard, write its arrays, and sum up its first and second words."""

    def store(rows: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merge():
            return _added(
                np.concatenate([keys, *(w[0] for w in waiting)]),
                np.concatenate([counts, *(w[1] for w in waiting)]),
            )

        held = 0
        for block in rows.column("block").to_pylist():
            gaps, some = _unpacked(block, np.int64, np.uint32)
            waiting.append((np.cumsum(gaps), some.astype(np.int64)))
            held += len(gaps)
            if held > max(CHUNK_PAIRS, len(keys) // 2):
                (keys, counts), waiting, held = merge(), [], 0
        keys, counts = merge()
        shard = rows.column("shard")[0].as_py()
        often = [int(np.count_nonzero(counts == n)) for n in (1, 2, 3, 4)]
        pairs = save(own_file(folder, "pairs", "npy"), keys)
        stored = save(own_file(folder, "pair-counts", "npy"), counts.astype(np.uint32))
        out = [(shard, pairs, stored, len(keys), *often, None, None)]
        # By first word: how many words follow once, twice, more often; by second: how many precede.
        first, starts = np.unique(keys >> 32, return_index=True)
        sums = [
            np.add.reduceat(flag.astype(np.uint32), starts, dtype=np.uint32)
            for flag in (counts == 1, counts == 2, counts > 2)
        ]
        second, precede = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        last = int(max(first.max(), second.max())) // part_words
        for part in range(last + 1):
            edge = [part * part_words, (part + 1) * part_words]
            one, two = (slice(*np.searchsorted(w, edge)) for w in (first, second))
            arrays = [first[one].astype(np.int64), *(s[one] for s in sums)]
            block = _packed(_gaps(arrays[0]), *arrays[1:])
            other = _packed(_gaps(second[two].astype(np.int64)), precede[two].astype(np.uint32))
            both = len(block).to_bytes(8, "little") + block + other
            out.append((shard, None, None, 0, 0, 0, 0, 0, part, both))
        names = [f.split()[0] for f in _STORED.split(", ")]
        types = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.binary()]
        return pa.table(
            {n: pa.array(list(c), t) for n, t, c in zip(names, types, zip(*out, strict=True), strict=True)}
        )

    return store


_PARTS = "part int, follow string, precede string, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint"


def _stored_words(folder: str, part_words: int, words: int):
    """Dense figures of the words of one part, from the sums of all shards."""

    def store(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        first = part * part_words
        n = min(part_words, words + 1 - first)  # one more: the start of a text
        follow = np.zeros((n, 3), np.uint32)
        precede = np.zeros(n, np.uint32)
        for block in rows.column("block").to_pylist():
            size = int.from_bytes(block[:8], "little")
            gaps, *sums = _unpacked(block[8 : 8 + size], np.int64, *[np.uint32] * 3)
            at = np.cumsum(gaps) - first
            for i in range(3):
                follow[at, i] += sums[i]
            gaps, count = _unpacked(block[8 + size :], np.int64, np.uint32)
            precede[np.cumsum(gaps) - first] += count
        often = [int(np.count_nonzero(precede == k)) for k in (1, 2, 3, 4)]
        return pa.table(
            {
                "part": pa.array([part], pa.int32()),
                "follow": [save(own_file(folder, "follow", "npy"), follow)],
                "precede": [save(own_file(folder, "precede", "npy"), precede)],
                **{f"n{k}": [often[k - 1]] for k in (1, 2, 3, 4)},
                "more": [int(np.count_nonzero(precede > 2))],
            }
        )

    return store


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0 to 3 and more, from counts of counts."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, 0.5, 0.75, 0.75])  # too few counts to estimate them
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


@dataclass
class Model:
    words: Vocabulary
    texts: int
    shard_tokens: int
    part_words: int
    pairs: list[str] = field(default_factory=list)
    pair_counts: list[str] = field(default_factory=list)
    follow: dict[int, str] = field(default_factory=dict)
    precede: dict[int, str] = field(default_factory=dict)
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    different: int = 0
    word_rest: float = 1.0

    def figures(self, files: dict[int, str], numbers: np.ndarray, width: int) -> np.ndarray:
        """Rows of the dense arrays for word numbers; zeros for unknown words."""
        out = np.zeros((len(numbers), width))
        parts = numbers // self.part_words
        for part in np.unique(parts[numbers >= 0]):
            own = np.flatnonzero(parts == part)
            if int(part) in files:
                rows = mapped(files[int(part)])[numbers[own] - part * self.part_words]
                out[own] = rows.reshape(len(own), width)
        return out

    def pair_count(self, before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Counts of pairs of word numbers, -1 being unknown."""
        counts = np.zeros(len(before), np.int64)
        known = np.flatnonzero((before >= 0) & (after >= 0))
        if not len(self.pairs) or not len(known):
            return counts
        keys = (before[known] << 32) | after[known]
        order = np.argsort(keys)
        known, keys = known[order], keys[order]
        part = _shard(keys >> 32, keys & 0xFFFFFFFF, weight[known], len(self.pairs), self.words.size, self.shard_tokens)
        by_part = np.argsort(part, kind="stable")  # keys stay ascending inside a shard
        edges = np.searchsorted(part[by_part], np.arange(len(self.pairs) + 1))
        for i, path in enumerate(self.pairs):
            own = by_part[edges[i] : edges[i + 1]]
            if not len(own) or not path:
                continue
            stored = mapped(path)
            at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
            hit = stored[at] == keys[own]
            counts[known[own[hit]]] = mapped(self.pair_counts[i])[at[hit]]
        return counts

    def score(self, bodies: list[bytes]):
        """Per text: tokens, known tokens, base score, and log10 probability under the model."""
        hashes, ids, sizes = tokenise(bodies)
        numbers, counts = self.words.look_up(hashes)
        vocabulary, tokens = self.words.size, self.words.tokens
        base = np.log10((counts + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        # Lower order: words by how many different words they follow.
        ahead = self.figures(self.precede, numbers, 1)[:, 0]
        lower = np.full(len(numbers), self.word_rest / (vocabulary + 1))
        if self.different:
            step = self.word_discounts[np.minimum(ahead, 3).astype(int)]
            lower += np.maximum(ahead - step, 0) / self.different
        # Higher order, with the start of a text behind all words.
        numbers, counts = np.append(numbers, vocabulary), np.append(counts, self.texts)
        rest = self.figures(self.follow, numbers, 3) @ self.pair_discounts[1:]
        before, after = pairs_of(ids, sizes, len(hashes))
        seen = self.pair_count(numbers[before], numbers[after], counts[before])
        total = np.maximum(counts[before], 1)
        cut = self.pair_discounts[np.minimum(seen, 3)]
        known_before = counts[before] > 0
        probability = np.where(
            known_before,
            np.maximum(seen - cut, 0) / total + rest[before] / total * lower[after],
            lower[after],
        )
        text = np.repeat(np.arange(len(sizes)), sizes)
        known = counts[after] > 0

        def per_text(values):
            return np.bincount(text, values, minlength=len(sizes))

        return sizes, per_text(known).astype(np.int64), per_text(base[after]), per_text(np.log10(probability))


def train(texts: DataFrame, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count the texts (column ``text``) and store the model in the shared folder."""
    folder = scratch(texts.sparkSession, "lm")
    words = count_words(texts, folder, shard_words)
    number = texts.count()
    model = Model(words, number, shard_tokens, shard_words)
    if not number:
        return model
    shards = max(1, -(-words.tokens // shard_tokens))
    blocks = texts.mapInArrow(
        _pair_blocks(words, shards, number, shard_tokens), "shard int, block binary"
    )
    stored = written(
        blocks.groupBy("shard").applyInArrow(_stored_pairs(folder, shard_words), _STORED), "lm-pairs"
    )
    files = {row["shard"]: row for row in stored.where("pairs IS NOT NULL").drop("block").collect()}
    model.pairs = [files[i]["pairs"] if i in files else "" for i in range(shards)]
    model.pair_counts = [files[i]["counts"] if i in files else "" for i in range(shards)]
    model.pair_discounts = discounts(*(sum(r[f"n{k}"] for r in files.values()) for k in (1, 2, 3, 4)))
    parts = written(
        stored.where("part IS NOT NULL")
        .select("part", "block")
        .groupBy("part")
        .applyInArrow(_stored_words(folder, shard_words, words.size), _PARTS),
        "lm-parts",
    ).collect()
    model.follow = {row["part"]: row["follow"] for row in parts}
    model.precede = {row["part"]: row["precede"] for row in parts}
    n1, n2, n3, n4 = (sum(row[f"n{k}"] for row in parts) for k in (1, 2, 3, 4))
    model.word_discounts = discounts(n1, n2, n3, n4)
    model.different = sum(row["distinct"] for row in files.values())
    more = sum(row["more"] for row in parts)
    if model.different:
        one, two, three = model.word_discounts[1:]
        model.word_rest = float((one * n1 + two * n2 + three * more) / model.different)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` (columns ``doc_id``, ``held_out`` and the text) with the scores of whole texts."""
    rows = docs.select("doc_id", "held_out", F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _bodies(batch.column("text"))
            for a, b in _chunks(bodies):
                sizes, known, base, probability = model.score(bodies[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("held_out").slice(a, b - a),
                        pa.array(sizes),
                        pa.array(known),
                        pa.array(np.full(b - a, model.words.tokens, np.int64)),
                        pa.array(base),
                        pa.array(probability),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        score,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
        " base_score double, score double",
    )


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on documents whose id's CRC-32 is no multiple of 10 and score all of them.

    Null and empty texts are one end token; a null id counts as the empty text, hence held out;
    repeated rows are trained on and scored each; without training texts every token has the
    uniform probability of the one unknown word; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0).alias("held_out"),
        F.col(text).alias("text"),
    )
    return scored(rows, train(rows.where("NOT held_out").select("text")))

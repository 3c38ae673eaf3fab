"""SentencePiece encoding and decoding with the pieces and scores of a given model file.

An Aho-Corasick automaton over the pieces reads a text byte by byte. At each position the output links
list the pieces that end there, longest first, and each one relaxes the best score of the position, so
one pass is a Viterbi search for the segmentation with the greatest sum of scores. A character that no
piece covers becomes byte pieces. A piece holds spaces at its start only, so the best segmentation of
a text is that of its space-led chunks; equal chunks of a slice are segmented once, all chunks of a
slice in step.

Spaces stand for the model's space mark, a text gets one leading space, and the mark character
itself goes to byte pieces, so decoding gives every text back unchanged.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; texts of any length
are encoded whole; ties keep the longer last piece; repeated rows give repeated results; other columns
are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from graphloom.llm.tokens import column_of, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 4 << 20
STEP_CELLS = 1 << 22


class Vocabulary:
    """Pieces of a model: bytes (the space mark as a space), scores, and the ids of byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.pieces, self.byte_ids = [b""] * n, np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[3:-1], 16)
                self.pieces[i], self.byte_ids[byte] = bytes([byte]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
        self.normal = [i for i in range(n) if self.pieces[i] and not model.is_byte(i)]


class Automaton:
    """Aho-Corasick automaton with a full transition table."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], [-1]
        for i in vocabulary.normal:
            node = 0
            for byte in vocabulary.pieces[i]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = i
        count = len(children)
        self.piece = np.array(ends, np.int32)
        self.link = np.zeros(count, np.int32)
        self.next = np.zeros((count, 256), np.int32)
        self.length = np.array([len(p) for p in vocabulary.pieces], np.int32)
        self.unknown = float(vocabulary.scores[vocabulary.normal].min()) - 10.0
        failure = np.zeros(count, np.int32)
        parent = np.array([n for n, c in enumerate(children) for _ in c], np.int32)
        byte = np.array([b for c in children for b in c], np.int32)
        child = np.array([x for c in children for x in c.values()], np.int32)
        level = np.array(depth)[child]
        for d in range(int(level.max(initial=0)) + 1):
            own = level == d
            p, b, c = parent[own], byte[own], child[own]
            if d > 0:  # failure nodes are shallower, so their rows are complete
                if d > 1:
                    failure[c] = self.next[failure[p], b]
                below = failure[c]
                self.next[c] = self.next[below]
                self.link[c] = np.where(self.piece[below] >= 0, below, self.link[below])
            own = level == d + 1
            self.next[parent[own], byte[own]] = child[own]

    def segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks behind each other, and the number of ids of each chunk."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        counts = np.zeros(len(lengths), np.int64)
        parts = []
        at = 0
        while at < len(order):
            to = min(len(order), at + max(1, STEP_CELLS // (int(lengths[order[at]]) + 1)))
            own = order[at:to]
            ids, n = self._segment_together(data, offsets[own], lengths[own])
            counts[own] = n
            parts.append((own, ids, n))
            at = to
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for own, ids, n in parts:
            place = np.repeat(ends[own] - n - np.cumsum(n) + n, n) + np.arange(len(ids))
            out[place] = ids
        return out, counts

    def _segment_together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks in falling order of length."""
        words, longest = len(starts), int(lengths[0])
        best = np.full((longest + 1, words), -np.inf)
        choice = np.full((longest + 1, words), -1, np.int32)
        best[0] = 0
        state = np.zeros(words, np.int32)
        char = np.zeros(words, np.int64)
        scores, length = self.vocabulary.scores, self.length
        active = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")
        for i in range(1, longest + 1):
            n = int(active[i])
            byte = data[starts[:n] + i - 1]
            state = self.next[state[:n], byte]
            node = np.where(self.piece[state] >= 0, state, self.link[state])
            live = np.flatnonzero(node)
            while len(live):
                piece = self.piece[node[live]]
                made = best[i - length[piece], live] + scores[piece]
                better = made > best[i, live]
                best[i, live[better]], choice[i, live[better]] = made[better], piece[better]
                node[live] = self.link[node[live]]
                live = live[node[live] > 0]
            # the end of a character: the next byte does not continue it
            last = lengths[:n] == i
            after = data[np.minimum(starts[:n] + i, len(data) - 1)]
            done = np.flatnonzero(last | ((after & 0xC0) != 0x80))
            made = best[char[done], done] + self.unknown
            better = done[made > best[i, done]]
            best[i, better] = best[char[better], better] + self.unknown
            choice[i, better] = -1
            char[done] = i
        position = lengths.astype(np.int64).copy()
        found_word, found_id = [], []
        live = np.flatnonzero(position > 0)
        while len(live):
            piece = choice[position[live], live]
            plain = piece >= 0
            byte = self.vocabulary.byte_ids[data[starts[live] + position[live] - 1]]
            found_word.append(live)
            found_id.append(np.where(plain, piece, byte))
            position[live] -= np.where(plain, length[np.maximum(piece, 0)], 1)
            live = live[position[live] > 0]
        if not found_word:
            return np.zeros(0, np.int32), np.zeros(words, np.int64)
        word, ids = np.concatenate(found_word[::-1]), np.concatenate(found_id[::-1])
        return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=words)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a string column."""
        data, offsets = utf8(texts)
        filled = np.diff(offsets) > 0
        led = np.full(len(data) + int(filled.sum()), 0x20, np.uint8)
        shift = np.cumsum(filled)
        where = np.arange(len(data)) + np.repeat(shift, np.diff(offsets))
        led[where] = data
        first = offsets + np.concatenate([[0], shift])
        space = led == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first[:-1][filled]] = True
        chunk = np.flatnonzero(begins)
        bounds = np.append(chunk, len(led)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(chunk), [None, pa.py_buffer(bounds), pa.py_buffer(led)])
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy()
        _, offset_buffer, data_buffer = coded.dictionary.buffers()
        unique_offsets = np.frombuffer(offset_buffer, np.int64)[: len(coded.dictionary) + 1] if len(chunk) else np.zeros(1, np.int64)
        unique_data = np.frombuffer(data_buffer, np.uint8) if len(chunk) else np.zeros(0, np.uint8)
        ids, counts = self.segment(unique_data, unique_offsets)
        start = np.cumsum(counts) - counts
        n = counts[index] if len(index) else np.zeros(0, np.int64)
        flat = ids[np.repeat(start[index] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] if len(index) else ids
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(chunk, first)]
        made = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat, pa.int32()))
        if texts.null_count:
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            made = pa.ListArray.from_arrays(pa.array(np.append(upto, 0)[:-1].astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array(~valid))
        return made


class Decoder:
    """Bytes of id sequences: a gather over the bytes of all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.data = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.length = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: pa.ListArray) -> pa.Array:
        bounds = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
        n = self.length[flat]
        made = self.data[np.repeat(self.start[flat] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[bounds - bounds[0]]
        drop = np.zeros(len(made), bool)
        led = ends[:-1][np.diff(ends) > 0]
        drop[led[made[led] == 0x20]] = True
        ends = ends - np.concatenate([[0], np.cumsum(drop)])[ends]
        made = made[~drop]
        valid = ids.is_valid()
        binary = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(made)])
        try:
            text = binary.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids that no text encodes to
            text = pa.array([b.decode(errors="replace") for b in binary.to_pylist()], pa.large_string())
        text = text.cast(pa.string())
        if ids.null_count:
            import pyarrow.compute as pc

            text = pc.if_else(valid, text, pa.scalar(None, pa.string()))
        return text


def _mapped(df: DataFrame, source: str, target: str, kind: DataType, make, path: str, size: int) -> DataFrame:
    """``df`` with one column more, made from another by ``make(vocabulary)`` in each task."""
    if target in df.columns:
        raise ValueError(f"there is already a column {target}")
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = StructType([*df.schema.fields, StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make(held.value)
        for batch in batches:
            for part in slices([batch], source, size) if isinstance(kind, ArrayType) else [batch]:
                yield pa.RecordBatch.from_arrays([*part.columns, apply(column_of(part, source))], [*part.schema.names, target])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of ``text``."""
    return _mapped(docs, text, ids, ArrayType(IntegerType()), lambda v: Automaton(v).encode, path, SLICE_BYTES)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ``ids``."""
    return _mapped(encoded, ids, text, StringType(), lambda v: Decoder(v).decode, path, SLICE_BYTES)


def digest(decoded: DataFrame) -> DataFrame:
    """Per document: number of ids, digest of the ids, and whether decoding gave the text back."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))

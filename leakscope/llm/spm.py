"""SentencePiece encoding and decoding with a given byte-pair model, by shared-prefix Viterbi.

A text is cut into marked words (runs of the blank mark with what follows); no piece of the
model reaches over such a cut, which is checked.  The distinct words are sorted, which puts
them in the order of a depth-first walk through their trie, and the forward state of each
prefix is computed once for all words that share it.  The state of a prefix is its last piece.
A step from a prefix to a longer one by a piece has score zero if the piece may follow the last
one, else minus infinity: two pieces may stand side by side if the merges of their joined text
end in just these two.  So exactly one path survives for each prefix, and it is the one that
the merges, best score first, would give.

The vocabulary is fixed and given; its bytes are sent with the task, so executors need no file.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship

ship(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text that are handled at once, and words whose pieces are kept between.
CHUNK, KEPT = 1 << 22, 1 << 17
NEVER = float("-inf")


class Pieces:
    """What encoding and decoding need of a model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        #: Every beginning of a piece; whether it is a whole piece.
        self.starts = {x[:k]: False for x in self.ids for k in range(1, len(x))} | dict.fromkeys(self.ids, True)
        self.surface = [b"" if sp.is_control(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        if any(BLANK in x.lstrip(BLANK) or "\n" in x for x in self.ids):
            raise ValueError("the model has pieces that reach over the end of a word")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts, get = list(text), self.score.get
        gain = [get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while gain and (best := max(gain)) > NEVER:
            at = gain.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(gain):
                gain[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts


class Encoder:
    """Pieces of sorted words; the forward states of the common prefix are taken over from the word before."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}
        self.after: dict[str, dict[str, bool]] = defaultdict(dict)  # piece -> pieces that may or may not follow it

    def encode(self, words: list[str]) -> None:
        """Put the ids of all ``words`` into ``known``, as the bytes of 32-bit numbers."""
        ids, starts, merged = self.pieces.ids, self.pieces.starts, self.pieces.merged
        byte, unknown, known, after = self.pieces.bytes, self.pieces.unknown, self.known, self.after
        # By length of the prefix: its last piece, where that begins, what may follow it, and from where a piece may still go on.
        last, begin, nexts, going, before = [""], [0], [{}], [()], ""
        for word in sorted(words):
            n, same = len(word), 0
            top = min(n, len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del last[same + 1 :], begin[same + 1 :], nexts[same + 1 :], going[same + 1 :]
            for d in range(same + 1, n + 1):
                on, found = [], False
                for s in (*going[-1], d - 1):
                    piece = word[s:d]
                    whole = starts.get(piece)
                    if whole is not None:
                        on.append(s)
                    if not found and (whole or s == d - 1):
                        may = s == 0 or nexts[s].get(piece)
                        if may is None:
                            may = nexts[s][piece] = merged(last[s] + piece) == [last[s], piece]
                        if may:
                            last.append(piece)
                            begin.append(s)
                            nexts.append(after[piece])
                            found = True
                going.append(on)
            out, d = [], n
            while d:
                i = ids.get(last[d])
                if i is not None:
                    out.append(i)
                elif byte:
                    out.extend(byte[b] for b in reversed(last[d].encode("utf-8", "replace")))
                else:
                    out.append(unknown)
                d = begin[d]
            out.reverse()
            known[word] = array("i", out).tobytes()  # no object for each id
            before = word

    def bound(self) -> None:
        """Forget what is kept beyond the limits."""
        if len(self.known) > KEPT:
            self.known.clear()
        if sum(map(len, self.after.values())) > 2 * KEPT:
            self.after.clear()


def _words(texts: pa.Array):
    """Marked words of all texts as one array, and where those of each text begin and end in it.

    A word begins with a text, a run of marks, a run of line feeds, or what follows such a run.
    """
    import numpy as np
    import pyarrow as arrow
    import pyarrow.compute as compute

    large = arrow.large_string()
    marked = compute.replace_substring(texts.cast(large), " ", BLANK)
    first = compute.if_else(compute.equal(compute.binary_length(marked), 0), arrow.scalar("", large), arrow.scalar(BLANK, large))
    marked = compute.binary_join_element_wise(first, marked, arrow.scalar("", large))
    ends = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends, mark = ends - ends[0], BLANK.encode()
    blank, line, start = np.zeros(len(data), bool), data == ord("\n"), np.zeros(len(data), bool)
    blank[:-2] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    start |= blank
    start[len(mark) :] &= ~blank[: -len(mark)]
    start[1:] |= line[1:] != line[:-1]
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.flatnonzero(start)
    words = arrow.LargeStringArray.from_buffers(len(at), arrow.py_buffer(np.append(at, len(data))), arrow.py_buffer(data))
    return words, np.searchsorted(at, ends)


def _encoded(texts: pa.Array, encoder: Encoder):
    """Ids of the texts of a chunk as one flat array, and their counts."""
    import numpy as np
    import pyarrow as arrow

    words, ends = _words(texts)
    numbered = words.dictionary_encode()
    distinct, order = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    encoder.bound()
    encoder.encode([w for w in distinct if w not in encoder.known])
    ids = [encoder.known[w] for w in distinct]
    sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    pieces = arrow.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), dtype=np.int32))
    total = np.concatenate([[0], np.cumsum(sizes[order], dtype=np.int64)])
    return pieces.take(numbered.indices).flatten().to_numpy(), np.diff(total[ends]).tolist()


def _encoded_batch(batch: pa.Array, encoder: Encoder):
    """Ids of all texts of a batch as (flat, ends of the texts), chunk by chunk."""
    import numpy as np
    import pyarrow.compute as compute

    flat, counts, begin, size = [np.zeros(0, np.int32)], [], 0, 0
    for i, length in enumerate(compute.binary_length(batch).to_pylist(), 1):
        size += length
        if size >= CHUNK or i == len(batch):
            got, n = _encoded(batch.slice(begin, i - begin), encoder)
            flat.append(got)
            counts += n
            begin, size = i, 0
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _decoded(flat, ends, surface: pa.Array) -> list[str]:
    """Texts of ids; ``surface`` holds the bytes of each id, and nothing at its end for those outside."""
    import numpy as np
    import pyarrow as arrow
    import pyarrow.compute as compute

    out = []
    for a in range(0, len(ends) - 1, 256):  # a few texts at a time: bounds the memory
        cut = ends[a : a + 257].astype(np.int64)
        ids = flat[cut[0] : cut[-1]]
        ids = np.where((ids < 0) | (ids >= len(surface) - 1), len(surface) - 1, ids)
        parts = arrow.LargeListArray.from_arrays(cut - cut[0], surface.take(arrow.array(ids)))
        whole = compute.binary_join(parts, arrow.scalar(b"", arrow.large_binary()))
        out += [x.removeprefix(b" ").decode("utf-8", "replace") for x in whole.to_pylist()]
    return out


def _surface(pieces: Pieces) -> pa.Array:
    import pyarrow as arrow

    return arrow.array([*pieces.surface, b""], arrow.large_binary())


def encode(text: Column, model: bytes) -> Column:
    """Struct of ``ids`` (empty for null and empty texts) and ``same``: whether they decode to the text.

    Encoding and its test by decoding run in one pass, so ids need not go back to a worker.
    """

    @F.arrow_udf("struct<ids: array<int>, same: boolean>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as arrow

        encoder = Encoder(Pieces(model))
        surface = _surface(encoder.pieces)
        for batch in batches:
            flat, ends = _encoded_batch(batch, encoder)
            same = [a.as_py() == b for a, b in zip(batch, _decoded(flat, ends, surface))]
            yield arrow.StructArray.from_arrays([arrow.ListArray.from_arrays(ends, flat), arrow.array(same, arrow.bool_())], names=["ids", "same"])

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, model: bytes) -> Column:
    """Text of an array of piece ids: blanks for marks, bytes joined, the added first blank taken off.

    A null array gives an empty text; null ids and ids outside the vocabulary are left out;
    bytes that are no UTF-8 become the replacement character.
    """

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        surface = _surface(Pieces(model))
        for batch in batches:
            flat = compute.fill_null(batch.flatten(), -1).to_numpy(zero_copy_only=False)
            counts = compute.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
            yield arrow.array(_decoded(flat, np.concatenate([[0], np.cumsum(counts)]), surface), arrow.string())

    return texts(ids)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokenize(docs: DataFrame, text: str = "text", path: str = MODEL, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip`` (whether the decoded ids are the text).

    A null text has no ids and its round trip is that of the empty text.  Texts that hold the blank mark
    itself, or are not valid UTF-8, do not come back.  Columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    model = read_model(path)
    out = docs.withColumn("_encoded", encode(F.col(text), model))
    return out.withColumns({ids: F.col("_encoded.ids"), "n_tokens": F.size("_encoded.ids"), "round_trip": F.col("_encoded.same")}).drop("_encoded")

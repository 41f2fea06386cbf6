"""Cutting oversized texts by lexical cohesion.

A text with more tokens than the limit is cut where its vocabulary changes: at every
natural boundary (blank line, line end, sentence end) the words of the sentences before
are compared with those of the sentences after (cosine of their counts); a low value
between two high ones is a valley, its depth is the sum of both climbs.  Going through
the text, the deepest valley within reach of the size limit becomes the cut, and the next
piece starts a fixed number of tokens before it.  Where only the first half of a window
holds a natural boundary its last one is taken, where the window holds none the last word start in it is taken, where it holds no word start the last token
that starts a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.bpe import ByteBPE, broadcast_bpe

LIMIT, OVERLAP = 1024, 64
#: Sentences on either side of a boundary whose words are compared.
BLOCK = 5
#: Boundaries compared at once; bounds the count matrix of very long texts.
SECTION = 256
#: A token of fewer bytes (its leading space included) is no content word.
CONTENT_BYTES = 4
#: Line ends: LF, CR LF, a lone CR, and the separators of lines and paragraphs.
_END = rb"(?:\r\n|\n|\r|\xe2\x80[\xa8\xa9])"
NATURAL = re.compile(_END + rb"[ \t]*(?:" + _END + rb"\s*)+|" + _END + rb"\s*|(?:[.!?]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\"')\]]*(?:[ \t]+|(?<=[\x80-\xff]))")
_ENDS = re.compile(_END)
KINDS = ("token", "word", "line", "sentence", "paragraph")
TOKEN, WORD, LINE, SENTENCE, PARAGRAPH = range(5)


def boundaries(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions at which a new line, sentence or paragraph starts, and which it
    is.  ``at``: the byte at which each token starts."""
    spots, kinds = [], []
    for m in NATURAL.finditer(data):
        a, b = m.span()
        first = data[a : a + 1]
        if first in b"\r\n\xe2":
            kinds.append(PARAGRAPH if first == b"\xe2" and data[a + 2] == 0xA9 or len(_ENDS.findall(data, a, b)) > 1 else LINE)
            spots.append((a, b))
        else:
            kinds.append(SENTENCE)
            spots.append((len(data[a:b].rstrip(b" \t")) + a, b))
    if not spots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = np.array(spots, np.int64)
    token = np.searchsorted(at, span[:, 1], side="right") - 1
    # the token that starts at the end of the gap, or the one that takes its space along
    good = (at[token] >= span[:, 0]) & (token > 0) & (span[:, 1] < len(data))
    token, kind = token[good], np.array(kinds, np.int64)[good]
    keep, where = np.unique(token, return_inverse=True)
    best = np.zeros(len(keep), np.int64)
    np.maximum.at(best, where, kind)
    return keep, best


def cohesion(ids: np.ndarray, sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Cosine of the word counts of the BLOCK sentences before and after each gap."""
    content = np.flatnonzero(sizes >= CONTENT_BYTES)
    sentence = np.searchsorted(gaps, content, side="right")
    out = np.zeros(len(gaps))
    for lo in range(0, len(gaps), SECTION):
        hi = min(lo + SECTION, len(gaps))
        first, last = max(0, lo + 1 - BLOCK), min(len(gaps), hi + BLOCK - 1)
        a, b = np.searchsorted(sentence, [first, last + 1])
        words, word = np.unique(ids[content[a:b]], return_inverse=True)
        n = last - first + 1
        counts = np.bincount((sentence[a:b] - first) * len(words) + word, minlength=n * len(words)).reshape(n, len(words)) if len(words) else np.zeros((n, 1))
        total = np.zeros((n + 1, counts.shape[1]), np.float32)
        np.cumsum(counts, axis=0, out=total[1:])
        g = np.arange(lo, hi) + 1 - first  # sentences before the gap, from first on
        left = total[g] - total[np.maximum(g - BLOCK, 0)]
        right = total[np.minimum(g + BLOCK, n)] - total[g]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        out[lo:hi] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """How far a gap lies below the peaks that its two slopes climb to."""
    s = similarity.tolist()
    left, right = s[:], s[:]
    for i in range(1, len(s)):
        if s[i - 1] >= s[i]:
            left[i] = left[i - 1]
    for i in range(len(s) - 2, -1, -1):
        if s[i + 1] >= s[i]:
            right[i] = right[i + 1]
    return np.array(left) + np.array(right) - 2 * similarity


def cuts(data: bytes, ids: np.ndarray, opens: np.ndarray, sizes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end token, kind of the boundary at the end) of each piece."""
    n = len(ids)
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    whole = (raw[at] & 0xC0) != 0x80  # tokens that start a character
    gaps, kinds = boundaries(data, at)
    kinds = kinds[whole[gaps]]
    gaps = gaps[whole[gaps]]
    deep = depths(cohesion(ids, sizes, gaps)) if len(gaps) else np.zeros(0)
    words, characters = np.flatnonzero(opens & whole), np.flatnonzero(whole)
    out, start = [], 0
    while n - start > limit:
        stop = start + limit
        # a piece is at least half full, so that a text has at most about twice the pieces it needs
        low = start + max(limit // 2, overlap + 1)
        a, b = np.searchsorted(gaps, [low, stop + 1])
        if a == b:  # rather a short piece than a cut inside a sentence: the last boundary there is
            first, b = np.searchsorted(gaps, [start + overlap + 1, stop + 1])
            a = max(first, b - 1)
        if a < b:
            k = a + int(np.lexsort((gaps[a:b], kinds[a:b], np.round(deep[a:b], 9)))[-1])
            end, kind = int(gaps[k]), int(kinds[k])
        else:
            for kind, among in ((WORD, words), (TOKEN, characters)):
                a, b = np.searchsorted(among, [start + overlap + 1, stop + 1])
                if a < b:
                    end = int(among[b - 1])
                    break
            else:
                end, kind = stop, TOKEN
        out.append((start, end, kind))
        start = end - overlap
    return [*out, (start, n, PARAGRAPH)]


def split_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` tokens, each repeating the last ``overlap`` tokens of
    its predecessor.

    Columns: the id, ``piece`` (from 1), ``pieces``, ``first_token``, ``end_token``,
    ``boundary`` (what the piece ends at: paragraph, sentence, line, word or token; the
    last one ends with the text) and, if ``with_text``, ``text``.  A text within the
    limit is one piece; null and empty texts give one piece without tokens, its text
    ''.  ``oversized_only`` leaves out the texts of a single piece; texts of at most
    ``limit`` bytes are then never sent to Python, since a token has at least one byte.
    The texts of pieces start and end between characters: a repeated part that would
    start inside a character has that character's first bytes dropped from the text,
    not from the token range.  Repeated ids are cut row by row; other columns are not
    read.  One narrow pass, no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    source = documents.select(id_column, text_column)
    if oversized_only:
        source = source.filter(F.octet_length(text_column) > limit)
    bpe = broadcast_bpe(documents.sparkSession, vocabulary)
    fields = [T.StructField(id_column, source.schema[id_column].dataType), *(T.StructField(x, T.IntegerType()) for x in ("piece", "pieces", "first_token", "end_token")), T.StructField("boundary", T.StringType())]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: ByteBPE = bpe.value
        for batch in batches:
            for lo, hi, ids, offsets, opens in encoder.encode_column(batch.column(1)):
                sizes = encoder.id_bytes[ids].astype(np.int64)
                at = np.append(0, np.cumsum(sizes))
                rows, parts, texts = [], [], []
                for r in range(hi - lo):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    if oversized_only and b - a <= limit:
                        continue
                    text = batch.column(1)[lo + r].as_py() or "" if with_text or b - a > limit else ""
                    data = text.encode("utf-8", "surrogatepass")
                    found = cuts(data, ids[a:b], opens[a:b], sizes[a:b], limit, overlap)
                    for k, (first, end, kind) in enumerate(found):
                        rows.append(lo + r)
                        parts.append((k + 1, len(found), first, end, kind))
                        if with_text:
                            texts.append(data[at[a + first] - at[a] : at[a + end] - at[a]].decode("utf-8", "ignore"))
                if rows:
                    columns = list(zip(*parts))
                    arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int32()) for c in columns[:4]), pa.array([KINDS[k] for k in columns[4]], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=schema.names)

    return source.mapInArrow(run, schema)


__all__ = ["LIMIT", "OVERLAP", "boundaries", "cohesion", "cuts", "depths", "split_documents"]

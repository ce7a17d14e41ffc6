"""Cutting oversized texts at natural boundaries into pieces with a fixed overlap.

A text over the limit gets the least number of pieces that can hold it, and its cuts are aimed at equal lengths. Each
cut then snaps to the strongest boundary within a reach of its aim (paragraph, line, sentence, word, character; the
nearest of equals). Where a piece then exceeds the limit, one piece is added and all cuts are aimed anew. A cut never
divides a character, and the next piece begins the overlap before the cut. Cuts where that place divides no character
either are preferred; where there is none within reach, up to three tokens more are shared.

A text whose UTF-8 bytes are no more than the limit has no more tokens than that, so only longer ones leave the JVM.

Edge cases: null, empty and short texts have no pieces; repeated texts are cut alike; a text of any length is cut whole;
a text without any boundary is cut between characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.counting import encoding
from ledgerloom.llm.tokens import VOCABULARY

LIMIT, OVERLAP = 1024, 64
#: How far a cut may move from its aim, in tokens.
REACH = 128
NEWLINE = rb"(?:\r\n|\r|\n|\xe2\x80\xa8|\xe2\x80\xa9|\xc2\x85)"
#: Boundaries by falling strength: the cut lies at the end of the first group, or in the white space after it.
BOUNDARIES = (
    (4, re.compile(rb"(" + NEWLINE + rb"[ \t]*" + NEWLINE + rb")\s*")),
    (3, re.compile(rb"(" + NEWLINE + rb")[ \t]*")),
    (2, re.compile(rb"((?:[.!?]|\xe2\x80\xa6|\xe0\xa5\xa4|\xd8\x9f|\xdb\x94|\xe3\x80\x82)[\"')\]]*)[ \t]+")),
)
SPACES = np.frombuffer(b" \t\n\r\f\v", dtype=np.uint8)  # beside them a cut has strength 1


def strengths(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Per token end (its offset in the text's bytes): the strength of a cut there, -1 where it would divide a character."""
    codes = np.frombuffer(data + b"\0", dtype=np.uint8)
    space = np.isin(codes, SPACES)
    at = np.zeros(len(data) + 1, dtype=np.int8)  # per place in the text, so that a boundary is marked by one slice
    at[1:] = space[1:] | space[:-1]
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(data):
            at[m.end(1) : m.end() + 1] = strength
    at[(codes & 0xC0) == 0x80] = -1
    return at[ends]


def cuts(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int]]:
    """(first token, end) of every piece; strength[i] is that of a cut after token i."""
    n = len(strength)
    if n <= limit:
        return [(0, n)]
    whole = np.flatnonzero(strength >= 0) + 1  # where a cut may lie: after so many tokens
    pieces = -(-(n - overlap) // (limit - overlap))
    while True:
        length, out, start, end = (n + (pieces - 1) * overlap) / pieces, [], 0, 0
        for j in range(1, pieces):
            aim = round(j * (length - overlap) + overlap)
            low, high = max(end + 1, aim - reach), min(n - 1, start + limit, aim + reach)
            near = whole[np.searchsorted(whole, low) : np.searchsorted(whole, high, "right")]
            if not len(near):
                break
            exact = near[(near <= overlap) | (strength[np.maximum(near - overlap - 1, 0)] >= 0)]
            near = exact if len(exact) else near  # where the overlap can begin between characters too
            force = strength[near - 1]
            near = near[force == force.max()]
            end = int(near[np.argmin(np.abs(near - aim))])
            out.append((start, end))
            back = np.searchsorted(whole, end - overlap, "right") - 1
            start = int(whole[back]) if back >= 0 else 0
        else:
            if n - start <= limit:
                return [*out, (start, n)]
        pieces += 1
        if pieces > n:
            raise ValueError("the limit is too small for the overlap")


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH, path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """doc_id, piece_no (from 1), n_pieces, start_token, end_token, n_tokens and text of the pieces of every text over the limit."""
    if not 0 <= overlap < limit // 2 or reach < 1:
        raise ValueError("the overlap must be under half the limit, the reach at least 1")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path)
        sizes = np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = coder.encode_to_numpy(text, disallowed_special=())
                if len(ids) <= limit:
                    continue
                data, ends = text.encode(), np.cumsum(sizes[ids])
                spans = cuts(strengths(data, ends), limit, overlap, reach)
                at = lambda k: int(ends[k - 1]) if k else 0
                rows += [(doc_id, i, len(spans), a, b, b - a, data[at(a) : at(b)].decode() if with_text else None) for i, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "n_pieces", "start_token", "end_token", "n_tokens", "text"])

    long = documents.select("doc_id", "text").filter(F.octet_length("text") > limit)
    return long.mapInPandas(cut, "doc_id bigint, piece_no int, n_pieces int, start_token int, end_token int, n_tokens int, text string")

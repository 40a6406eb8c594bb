"""JSON documents as arrays: every value a row, with its parent, its place and the bytes it spans.

A batch of documents is scanned as one byte buffer: string literals, brackets,
commas and colons are found with array operations, nesting depth is a running sum,
and the enclosing value of each separator comes from a search among the openings
one level up. No document and no value is visited one by one; Python loops over
the levels of nesting only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[list(b"{[")] = True
_CLOSE[list(b"}]")] = True
_MARK = _OPEN | _CLOSE
_MARK[list(b",:")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer | None]:
    """The bytes of all texts, one blank after each so that no two run together, where each starts, and the buffer."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1)
    if not len(ends):
        return np.zeros(0, np.uint8), ends, None
    data = pc.binary_join_element_wise(texts, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())).buffers()[2]
    return np.frombuffer(data, np.uint8, ends[-1]), ends - lengths - 1, data


def _quotes(b: np.ndarray) -> np.ndarray:
    """Where a quotation mark opens or closes a literal: those that an odd number of backslashes precedes do neither."""
    quote, slash = b == ord('"'), b == ord("\\")
    if slash.any():
        other = np.maximum.accumulate(np.where(~slash, np.arange(len(b)), -1))
        at = np.flatnonzero(quote)
        before = np.where(at > 0, at - 1 - other[np.maximum(at - 1, 0)], 0)
        quote[at[before % 2 == 1]] = False
    return quote


def _sound(texts: pa.Array) -> pa.Array:
    """``texts``, empty where literals or brackets are not closed or close more than they open, so that none spoils its neighbours."""
    b, starts, _ = _buffer(texts)
    if not len(starts):
        return texts
    quote = _quotes(b)
    odd = np.add.reduceat(quote, starts, dtype=np.int64) % 2 == 1
    if odd.any():
        return _sound(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts))
    outside = np.cumsum(quote) % 2 == 0
    step = np.where(outside, _OPEN[b].astype(np.int64) - _CLOSE[b], 0)
    depth = np.cumsum(step)
    before = depth[starts] - step[starts]
    ends = np.append(starts[1:], len(b)) - 1
    bad = (depth[ends] != before) | (np.minimum.reduceat(depth, starts) < before)
    return _sound(pc.if_else(pa.array(bad), pa.scalar("", texts.type), texts)) if bad.any() else texts


class Values:
    """The values of valid JSON ``documents`` in the order in which they begin.

    parent: the row of the enclosing value, -1 of a document itself; place: from 0
    among its siblings as delivered; kind: the first byte of the value; key: the
    name of an object's member, else null; document: which one it is in. Null
    documents have no values.
    """

    def __init__(self, documents: pa.Array) -> None:
        texts = _sound(pc.fill_null(documents, "").cast(pa.large_string()))
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        b, starts, data = _buffer(texts)
        quote = _quotes(b)
        inside = np.cumsum(quote) % 2 == 1  # from an opening quote up to before its closing one
        marks = np.flatnonzero(_MARK[b] & ~inside)
        m = b[marks]
        depth = np.cumsum(_OPEN[m].astype(np.int64) - _CLOSE[m])
        solid = np.flatnonzero(~_BLANK[b])

        def first(at: np.ndarray) -> np.ndarray:
            """The place of the first byte at or after ``at`` that is no blank; the length of the buffer where there is none."""
            k = np.searchsorted(solid, at)
            return np.append(solid, len(b))[k]

        full = starts[lengths > 0]
        roots = first(full)
        is_root = np.concatenate([np.ones(len(roots), bool), np.zeros(len(marks), bool)])
        # a value begins after an opening bracket, a comma in a list, or a colon
        level = depth - np.where(_OPEN[m], 1, 0)  # depth of the value that a mark belongs to, counted outside
        encloser = np.full(len(marks), -1)  # the opening mark around each comma and colon, and around what an opening mark opens
        for d in range(int(depth.max(initial=0)) + 1):
            opens = np.flatnonzero(_OPEN[m] & (depth == d))
            own = np.flatnonzero(~_OPEN[m] & ~_CLOSE[m] & (depth == d))
            if len(opens):
                encloser[own] = opens[np.searchsorted(opens, own) - 1]
                encloser[opens] = opens
        listed = np.zeros(len(marks), bool)
        known = encloser >= 0
        listed[known] = m[encloser[known]] == ord("[")
        after = first(marks + 1)
        begins = (m == ord(":")) | (listed & (m == ord(","))) | (listed & _OPEN[m] & (b[np.minimum(after, len(b) - 1)] != ord("]")) if len(b) else False)
        born = np.flatnonzero(begins)
        at = np.concatenate([roots, after[born]])
        holder = np.concatenate([np.full(len(roots), -1), encloser[born]])  # opening mark of the parent
        colon = np.concatenate([np.full(len(roots), -1), np.where(m[born] == ord(":"), born, -1)])
        order = np.argsort(at, kind="stable")
        self.at, holder, colon, is_root = at[order], holder[order], colon[order], is_root[: len(at)][order]
        self.kind = b[np.minimum(self.at, max(len(b) - 1, 0))] if len(b) else np.zeros(0, np.uint8)
        # the row of a value is found by where it begins, that of a parent by its opening mark
        self.parent = np.where(holder < 0, -1, np.searchsorted(self.at, marks[np.maximum(holder, 0)])) if len(marks) else np.full(len(self.at), -1)
        self.document = np.searchsorted(starts, self.at, "right") - 1 if len(starts) else np.zeros(0, np.int64)
        by = np.argsort(self.parent, kind="stable")
        run = self.parent[by]
        head = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
        starts_of = np.maximum.accumulate(np.where(head, np.arange(len(run)), 0)) if len(run) else np.zeros(0, np.int64)
        self.place = np.zeros(len(run), np.int64)
        self.place[by] = np.arange(len(run)) - starts_of
        # what lies between two marks, as strings that share the buffer
        edges = np.concatenate([[0], marks + 1, [len(b)]]).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), data) if len(b) else pa.array([], pa.large_string())
        self._pieces, self._marks = pieces, marks
        named = np.flatnonzero(colon >= 0)
        keys = np.full(len(self.at), -1)
        keys[named] = colon[named]
        self.key = pc.utf8_trim(pc.utf8_trim_whitespace(self._piece(keys)), ' ":\t\r\n')

    def _piece(self, k: np.ndarray) -> pa.Array:
        """The text before the marks ``k``, each with the mark; null for -1."""
        return self._pieces.take(pa.array(k, mask=k < 0))

    def member(self, name: str) -> np.ndarray:
        """Of each value the row of its member ``name``, the last one if it is repeated; -1 where there is none."""
        out = np.full(len(self.at) + 1, -1)
        rows = np.flatnonzero(pc.fill_null(pc.equal(self.key, name), False).to_numpy(zero_copy_only=False))
        out[self.parent[rows]] = rows
        return out[:-1]

    def texts(self, rows: np.ndarray) -> pa.Array:
        """The text of scalar values inside others, blanks around them dropped."""
        k = np.searchsorted(self._marks, self.at[rows])
        text = self._pieces.take(pa.array(k))
        return pc.utf8_trim(text, " \t\r\n,]}")

    def numbers(self, rows: np.ndarray) -> pa.Array:
        """The number that each value is; null of any other value."""
        kind = self.kind[rows]
        is_number = (kind == ord("-")) | ((kind >= ord("0")) & (kind <= ord("9")))
        out = pa.nulls(len(rows), pa.float64())
        if is_number.any():
            found = self.texts(rows[is_number]).cast(pa.float64())
            place = np.full(len(rows), -1)
            place[is_number] = np.arange(int(is_number.sum()))
            out = found.take(pa.array(place, mask=place < 0))
        return out

    def strings(self, rows: np.ndarray) -> pa.Array:
        """The literal that each value is, without its quotes; null of any other value. Escapes stay as they are."""
        quoted = self.kind[rows] == ord('"')
        # a literal may hold marks: its piece is cut at the next mark outside literals, so it is whole
        text = pc.utf8_slice_codeunits(self.texts(rows), 1, -1) if len(rows) else pa.array([], pa.large_string())
        return pc.if_else(pa.array(quoted), text, pa.scalar(None, text.type))

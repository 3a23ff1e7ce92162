"""Characters placed in table cells, and their text, in numpy over Arrow batches: tables stand one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are taken together, about; pairs of a character and a cell at most.
ROWS, PAIRS = 50_000, 1_000_000
#: What (?U)\s matches, as trim_py trims.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Bands are told from coordinates within these bounds, so that differences stay finite.
FAR = 1e150


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= ROWS:
            yield joined(held)
            held, rows = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def doubles(a: pa.Array) -> np.ndarray:
    """Nulls as the least, as they are ordered."""
    return pc.fill_null(a.cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False)


def whole(a: pa.Array) -> np.ndarray:
    least = np.iinfo(np.int64).min
    return pc.fill_null(a.cast(pa.int64()), pa.scalar(least, pa.int64())).to_numpy(zero_copy_only=False)


def changes(a: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before, null from null not; the first does."""
    out = np.ones(len(a), dtype=bool)
    if len(a) > 1:
        now, before = a.slice(1), a.slice(0, len(a) - 1)
        out[1:] = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        if a.null_count:
            gone = a.is_null().to_numpy(zero_copy_only=False)
            out[1:] |= gone[1:] != gone[:-1]
    return out


def spread(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each, counts numbers."""
    return np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)


def first_cells(table: np.ndarray, chars: list[np.ndarray], of: np.ndarray, cells: list[np.ndarray], band: float) -> np.ndarray:
    """Of each character (table, x0, y0, x1, y1) the number of the first cell (table, x_start, y_start, x_end, y_end) of its
    table that it overlaps, or else that holds its centre, or -1. Cells stand by table, the first before others; both
    tables are numbered from 0.

    Cells are dealt to the bands of y that they reach, of `band` at least and no more than a table has cells; a character
    meets those in the bands that it reaches, which stand together."""
    best = np.full(len(table), -1, dtype=np.int64)
    if not len(of) or not len(table):
        return best
    x0, y0, x1, y1 = chars
    with np.errstate(all="ignore"):
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    # NaN is the greatest, as it is ordered
    x0, y0, x1, y1, mx, my, xs, ys, xe, ye = (np.where(np.isnan(a), np.inf, a) if np.isnan(a).any() else a for a in (x0, y0, x1, y1, mx, my, *cells))
    n = int(max(table.max(), of.max())) + 1
    count = np.bincount(of, minlength=n)
    top, bottom = (f(np.clip(ys, -FAR, FAR), np.clip(ye, -FAR, FAR)) for f in (np.minimum, np.maximum))
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    low, high = np.zeros(n), np.zeros(n)
    low[of[starts]], high[of[starts]] = np.minimum.reduceat(top, starts), np.maximum.reduceat(bottom, starts)
    deep = np.maximum(band, (high - low) / np.maximum(count, 1))
    bands = np.where(count > 0, np.floor((high - low) / deep).astype(np.int64) + 1, 0)
    base = np.cumsum(bands) - bands
    at = lambda y, t: np.clip(np.floor((np.clip(y, -FAR, FAR) - low[t]) / deep[t]), -1, bands[t]).astype(np.int64)
    first, last = at(top, of), np.minimum(at(bottom, of), bands[of] - 1)
    reach = last - first + 1
    entry = np.repeat(np.arange(len(of)), reach)
    bucket = spread(reach, base[of] + first)
    by = np.argsort(bucket, kind="stable")
    entry = entry[by]
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=int(bands.sum())))])
    first, last = at(np.minimum(y0, y1), table), at(np.maximum(y0, y1), table)
    near = (first < bands[table]) & (last >= 0)
    who = np.flatnonzero(near)
    t = table[who]
    begin = ends[base[t] + np.maximum(first[who], 0)]
    pairs = ends[base[t] + np.minimum(last[who], bands[t] - 1) + 1] - begin
    so_far = np.cumsum(pairs)
    k = 0
    while k < len(who):
        done = so_far[k - 1] if k else 0
        to = max(k + 1, int(np.searchsorted(so_far, done + PAIRS, side="right")))
        char, cell = np.repeat(who[k:to], pairs[k:to]), entry[spread(pairs[k:to], begin[k:to])]
        k = to
        over, centre = sees(char, cell, y0, y1, my, ys, ye)
        keep = over | centre
        char, cell, over, centre = char[keep], cell[keep], over[keep], centre[keep]
        over_x, centre_x = sees(char, cell, x0, x1, mx, xs, xe)
        over, centre = over & over_x, centre & centre_x
        keep = over | centre
        char, rank = char[keep], np.where(over[keep], 0, len(of)) + cell[keep]
        if len(char):
            heads = np.flatnonzero(np.diff(char, prepend=-1))
            best[char[heads]] = np.minimum.reduceat(rank, heads) % len(of)
    return best


def sees(char: np.ndarray, cell: np.ndarray, a0: np.ndarray, a1: np.ndarray, middle: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, whether they overlap, and whether the cell holds the middle, on one axis."""
    s, e, m = start[cell], end[cell], middle[char]
    return (a0[char] < e) & (a1[char] > s), (m >= s) & (m <= e)


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows one after the other, while they have fewer than ROWS characters, but one at least."""
    so_far = np.cumsum(pc.list_value_length(b.column("chars")).to_numpy(zero_copy_only=False))
    k = 0
    while k < b.num_rows:
        to = max(k + 1, int(np.searchsorted(so_far, (so_far[k - 1] if k else 0) + ROWS, side="right")))
        yield b.slice(k, to - k)
        k = to


def placed(batches: Iterator[pa.RecordBatch], band: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, chars, cells) with lists of (char_no, c, x0, y0, x1, y1) and of (row_index, col_index, x_start, y_start,
    x_end, y_end) -> characters that have a cell, with its row_index and col_index."""
    for b in (part for whole_batch in batches for part in slices(whole_batch)):
        (table, chars), (of, cells) = listed(b.column("chars")), listed(b.column("cells"))
        order = np.lexsort((whole(cells["col_index"]), whole(cells["row_index"]), of))
        found = first_cells(table, [doubles(chars[c]) for c in ("x0", "y0", "x1", "y1")], of[order], [doubles(cells[c])[order] for c in ("x_start", "y_start", "x_end", "y_end")], band)
        for c in ("x0", "y0", "x1", "y1"):
            if chars[c].null_count:
                found[chars[c].is_null().to_numpy(zero_copy_only=False)] = -1
        some = np.flatnonzero(found >= 0)
        if len(some):
            at, own = pa.array(order[found[some]]), pa.array(some)
            told = {k: v if len(some) == len(found) else v.take(own) for k, v in chars.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(table[some]))} | told | {k: cells[k].take(at) for k in ("row_index", "col_index")})


def listed(a: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Number of the row of each struct in lists, and the structs' fields."""
    own = a.flatten()
    rows = np.repeat(np.arange(len(a)), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))
    return rows, dict(zip((f.name for f in own.type), own.flatten(), strict=True))


def line_starts(y: np.ndarray, group: np.ndarray, gap: float) -> np.ndarray:
    """Whether a place starts a line; y are sorted in each group, groups stand together. One at gap or more from its
    line's first does. One at gap or more from the one before does in any case; only what drifts is told step by step."""
    new = np.ones(len(y), dtype=bool)
    with np.errstate(invalid="ignore"):
        new[1:] = (group[1:] != group[:-1]) | ~(y[1:] - y[:-1] < gap)
        part = np.cumsum(new) - 1
        far = np.flatnonzero(~(y - y[new][part] < gap) & ~new)
        while len(far):
            head = np.diff(part[far], prepend=-1) != 0
            new[far[head]] = True
            far = far[~(y[far] - y[far[head]][np.cumsum(head) - 1] < gap) & ~head]
    return new


def texts_of(b: pa.RecordBatch, gap: float) -> pa.RecordBatch:
    """Placed characters of whole tables -> (doc_id, row_index, col_index, text) of each cell."""
    table, row, col = np.cumsum(changes(b.column("doc_id"))), whole(b.column("row_index")), whole(b.column("col_index"))
    y, n = doubles(b.column("y0")), whole(b.column("char_no"))
    with np.errstate(all="ignore"):
        x = (doubles(b.column("x0")) + doubles(b.column("x1"))) / 2
    by = np.lexsort((col, row, table))
    differ = np.ones(len(by), dtype=bool)
    differ[1:] = (table[by][1:] != table[by][:-1]) | (row[by][1:] != row[by][:-1]) | (col[by][1:] != col[by][:-1])
    cell = np.empty(len(by), dtype=np.int64)
    cell[by] = np.cumsum(differ) - 1
    one_by_one = gap <= 0 or not np.isfinite(y).all()
    by = np.lexsort((n, x, y, cell) if one_by_one else (y, cell))
    line = np.empty(len(by), dtype=np.int64)
    line[by] = np.cumsum(line_starts(y[by], cell[by], gap)) - 1
    by = np.lexsort((x, line))
    alike = (x[by][1:] == x[by][:-1]) & (line[by][1:] == line[by][:-1])
    c = b.column("c").cast(pa.string())
    if alike.any() or np.isnan(x).any():
        kinds = c.dictionary_encode()
        rank = np.argsort(np.argsort(np.array([(v or "").encode() for v in kinds.dictionary.to_pylist()], dtype=object), kind="stable"), kind="stable")
        rank = np.concatenate([rank, [-1]])[pc.fill_null(kinds.indices, len(rank)).to_numpy(zero_copy_only=False)]
        by = np.lexsort((rank, n, y, x, line))
    cell, line = cell[by], line[by]
    start = np.diff(cell, prepend=-1) != 0
    broken = (np.diff(line, prepend=-1) != 0) & ~start
    c = c.take(pa.array(by))
    # a null character is left out, and the break before it
    pieces = pc.fill_null(pc.binary_join_element_wise(pa.array(["", "<br>"]).take(pa.array(broken.astype(np.int8))), c, ""), "")
    heads = np.flatnonzero(start)
    ends = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    offsets = np.concatenate([ends[heads], ends[-1:]]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pieces.buffers()[2] or pa.py_buffer(b""))
    at = pa.array(by[heads])
    return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in ("doc_id", "row_index", "col_index")), pc.utf8_trim(text, characters=WHITE)], names=["doc_id", "row_index", "col_index", "text"])


def texts(batches: Iterator[pa.RecordBatch], gap: float) -> Iterator[pa.RecordBatch]:
    """Placed characters, those of a table one after the other -> their cells' texts. The last table waits for more."""
    waiting: list[pa.RecordBatch] = []
    for b in gathered(batches):
        if waiting:
            ahead = joined([waiting[-1].slice(waiting[-1].num_rows - 1), b.slice(0, 1)]).column("doc_id")
            goes_on = not changes(ahead)[1]
        else:
            goes_on = True
        heads = np.flatnonzero(changes(b.column("doc_id")))
        if goes_on and len(heads) == 1:
            waiting.append(b)
            continue
        yield texts_of(joined([*waiting, b.slice(0, heads[-1])]) if heads[-1] else joined(waiting), gap)
        waiting = [b.slice(heads[-1])]
    if waiting:
        yield texts_of(joined(waiting), gap)

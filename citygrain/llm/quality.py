"""Per-document text statistics that tell prose from lists, tables and junk.

All texts of a batch are one byte buffer with a line end after each text; statistics of lines are differences of running
sums over it. Tables show in delimiters or column edges at the same places of neighbouring lines, lists in markers, in
indentation and line lengths that repeat at a lag, junk in lines that repeat but for their numbers. Together with word,
symbol and punctuation ratios they decide which lines hold sentences of natural language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.operators.buffers import code, last_index, passes, string_bytes

# Environments that look like prose but are none; the rest of the markup shows by its structure.
ENVIRONMENTS = "thebibliography verbatim lstlisting comment filecontents".split()
_ENV = re.compile(rb"\\(begin|end)\s*\{(" + "|".join(ENVIRONMENTS).encode() + rb")\*?\}|\\(iffalse|fi)\b")

#: A block of lines is prose from these shares on: common words among words, letters among non-blank characters.
COMMON_SHARE, LETTER_SHARE = 0.14, 0.55
#: Words per sentence that a block of prose, or a marked line, must have at least.
WORDS_PER_SENTENCE, WORDS_PER_ITEM = 3.5, 6
ALIGNED_LINES = 3
#: Lines of one text that are equal but for blanks and numbers repeat from this number on.
REPEATED_LINES = 3
#: A run is regular if its lines' lengths or indents correlate this much with those a few lines before, in so many lines
#: at least. It is a list if it also has fewer sentence ends a line than this; wrapped prose has one in two lines or more.
REGULAR, REGULAR_LINES, LIST_ENDS = 0.6, 8, 0.3
LENGTH_LAGS, INDENT_LAGS = (2, 3, 4), (1, 2, 3, 4)
#: Delimiters of table cells, and how many of one a line has at least.
DELIMITERS = ((38, 1), (124, 2), (9, 1), (44, 2), (59, 2))
#: Bytes from which the lines of a text are read in parts, to bound the memory of a task; the result is that of the whole.
LONG_BYTES = 4 << 20

STATISTICS = {
    "n_words": "long", "mean_word_length": "double", "symbol_share": "double", "digit_share": "double", "terminal_line_share": "double", "common_word_share": "double",
    "table_line_share": "double", "list_line_share": "double", "length_autocorrelation": "double", "indent_periodicity": "double", "comment_share": "double", "sentence_share": "double", "kind": "string",
}

_LETTER, _DIGIT, _BLANK, _END, _OPEN_END = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_END[list(b".!?:;")] = True
_OPEN_END[list(b")}]$\"'*`")] = True
_ITEM = code("item")
#: An odd factor of the hashes of words and lines, which wrap around at 64 bits.
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=65_536)
def _point(c: int) -> tuple[str, bytes]:
    """(L, N, Z or S for letters and marks, numbers, blanks and symbols; bytes in lower case if there are as many) of a code point."""
    own = chr(c) if not 0xD800 <= c < 0xE000 and c < 0x110000 else "?"
    kind = unicodedata.category(own)
    low = own.lower().encode()
    kind = "L" if kind[0] in "LM" else kind[0] if kind[0] in "NZ" else "Z" if own.isspace() else "S"
    return kind, low if len(low) == len(own.encode()) else own.encode()


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is it of a letter, a number, a blank; does it begin a character; and the bytes in lower case."""
    letter, digit, blank, begins = _LETTER[data], _DIGIT[data], _BLANK[data], (data & 0xC0) != 0x80
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        at = [np.minimum(lead + k, len(data) - 1) for k in range(4)]
        point = data[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            point = np.where(size > k, (point << 6) | (data[at[k]] & 0x3F), point)
        points, which = np.unique(point, return_inverse=True)
        known = [_point(c) for c in points.tolist()]
        kind = np.array([k for k, _ in known])[which]
        low = np.array([list(x.ljust(4, b"\0")[:4]) for _, x in known], np.uint8)[which]
        for k in range(4):
            on = size > k
            to = at[k][on]
            letter[to], digit[to], blank[to] = kind[on] == "L", kind[on] == "N", kind[on] == "Z"
            lower[to] = low[on, k]
    return letter, digit, blank, begins, lower


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the factor and of its inverse, up to ``n``."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, f, np.uint64))]) for f in (np.uint64(_FACTOR), np.uint64(pow(_FACTOR, -1, 1 << 64))))


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes, from one running sum."""
    power, inverse = _powers(1 << max(10, (len(data) + 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        return (total[stop] - total[start]) * inverse[start]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _lagged(value: np.ndarray, doc: np.ndarray, n: int, lags: tuple[int, ...]) -> np.ndarray:
    """Per document the highest autocorrelation of a line value over the lags."""
    many = np.bincount(doc, minlength=n)
    centred = value - _ratio(np.bincount(doc, value, n), many)[doc]
    power = np.bincount(doc, centred * centred, n)
    best = np.zeros(n)
    for lag in lags:
        if len(value) > lag:
            same = doc[lag:] == doc[:-lag]
            product = np.bincount(doc[lag:][same], (centred[lag:] * centred[:-lag])[same], n)
            best = np.maximum(best, np.where(many > 2 * lag + 2, _ratio(product, power), 0))
    return best


def _runs(flag: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Lines that are part of at least ``least`` neighbouring flagged lines of a document."""
    if not len(flag):
        return flag
    change = np.flatnonzero(np.concatenate([[True], (flag[1:] != flag[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.append(change, len(flag)))
    return flag & np.repeat(size >= least, size)


def measure(texts: pa.Array, common: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text; ``common`` has the hashes of the common words, sorted.

    A text beyond LONG_BYTES is measured alone. Only the values of its lines are taken in parts; what reaches over
    lines (environments, blocks, aligned runs, autocorrelations) is decided over all of them.
    """
    long_ = [i for i, t in enumerate(pc.binary_length(texts).to_pylist()) if t and t > LONG_BYTES]
    if not long_:
        return _measure(texts, common)
    out = _measure(pc.if_else(pa.array(np.isin(np.arange(len(texts)), long_)), pa.scalar(None, texts.type), texts), common)
    for i in long_:
        for k, v in _measure(texts.slice(i, 1), common).items():
            out[k][i] = v[0]
    return out


def _parts(text: str | bytes) -> Iterator:
    """The text in parts of about LONG_BYTES / 4 that end at line ends; a longer line is in one part."""
    feed, back = ("\n", "\r") if isinstance(text, str) else (b"\n", b"\r")
    at = 0
    while at < len(text):
        end = min(at + LONG_BYTES // 4, len(text))
        if end < len(text):
            cut = max(text.rfind(feed, at, end), text.rfind(back, at, end))
            if cut < 0:
                cut = text.find(feed, end)
                sooner = text.find(back, end, cut if cut >= 0 else len(text))
                cut = sooner if sooner >= 0 else cut
            end = cut + 1 if cut >= 0 else len(text)
            # A carriage return and its line feed are one line end.
            end += text[end - 1 : end] == back and text[end : end + 1] == feed
        yield text[at:end]
        at = end


def _kind(found: dict[str, np.ndarray]) -> np.ndarray:
    listed = (found["list_line_share"] >= 0.3) | (found["length_autocorrelation"] >= 0.35) | (found["indent_periodicity"] >= 0.8)
    other = np.where(found["table_line_share"] >= 0.3, "table", np.where(listed, "list", "junk"))
    return np.where(found["_solid"] == 0, "empty", np.where(found["sentence_share"] >= 0.5, "prose", other))


def _line_values(data: np.ndarray, off: np.ndarray, common: np.ndarray, prior: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """Values of each line that only need its bytes and, for column edges, the line above; ``prior`` is the part before."""
    size = len(data)
    places = np.arange(size, dtype=np.int32 if size < 2**31 - 1 else np.int64)
    before = np.concatenate([[10], data[:-1]])
    twice = np.concatenate([[10], before[:-1]])
    # Lines: they end at a line feed, at a carriage return without one, and at the end of a text.
    feed = (data == 10) | (data == 13)
    feed[:-1] &= ~((data[:-1] == 13) & (data[1:] == 10))
    bounds = np.unique(np.concatenate([off[:-1], np.flatnonzero(feed) + 1]))
    start = bounds[bounds < size]
    stop = np.append(start[1:], size)
    lines = len(start)

    letter, digit, blank, begins, lower = _classes(data)
    solid = ~blank
    cut = np.minimum.reduceat(np.where((data == 37) & (before != 92), places, size), start)
    code_stop = np.minimum(cut, stop)

    def per_line(mask: np.ndarray, end: np.ndarray = stop) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[end] - total[start]).astype(np.int64)

    visible = solid & begins
    solid_all, solid_code = per_line(visible), per_line(visible, code_stop)
    letters, digits = per_line(letter & begins, code_stop), per_line(digit & begins)
    first_solid = np.minimum.reduceat(np.where(solid, places, size), start)
    first_solid = np.minimum(first_solid, stop - 1)
    indent = np.where(solid_all > 0, first_solid - start, 0)
    width = np.where(solid_all > 0, per_line(begins & ~feed), 0)

    # Words: runs of letters. A line end closes each text, so none runs on into the next.
    was_letter = np.concatenate([[False], letter[:-1]])
    word_start = np.flatnonzero(letter & ~was_letter)
    word_stop = np.flatnonzero(was_letter & ~letter)
    if len(word_stop) < len(word_start):
        word_stop = np.append(word_stop, size)
    word = _hashes(lower, word_start, word_stop)
    at = np.searchsorted(common, word)
    is_common = (common[np.minimum(at, len(common) - 1)] == word) if len(common) else np.zeros(len(word), bool)
    word_line = np.searchsorted(start, word_start, "right") - 1
    in_code = word_start < code_stop[word_line]
    plain = in_code & (before[word_start] != 92)
    words = np.bincount(word_line[plain], minlength=lines)
    commons = np.bincount(word_line[plain & is_common], minlength=lines)

    # Sentence ends: a stop after a word of two letters, a bracket or math, before white space or closing marks.
    stops = np.flatnonzero(_END[data])
    ahead, behind = np.minimum(stops + 1, size - 1), np.maximum(stops - 1, 0)
    last_line = stops + 1 >= stop[np.searchsorted(start, stops, "right") - 1]
    word_before = (letter[behind] & (behind < stops)) & (letter[np.maximum(stops - 2, 0)] & (stops > 1))
    ends = stops[(blank[ahead] | last_line | _OPEN_END[data[ahead]]) & (word_before | _OPEN_END[before[stops]])]
    end_line = np.searchsorted(start, ends, "right") - 1
    end_line = end_line[ends < code_stop[end_line]]
    terminals = np.bincount(end_line, minlength=lines)
    final = last_index(solid)[np.maximum(code_stop - 1, 0)]
    closing = data[np.maximum(final, 0)]
    closes = (final >= start) & (_END[closing] | (_OPEN_END[closing] & _END[before[np.maximum(final, 0)]]))

    # Lines of markup begin with a command and have no word outside commands and their arguments, unless these hold sentences.
    lead = data[first_solid] == 92
    escaped = before == 92
    nesting = np.cumsum((((data == 123) | (data == 91)) & ~escaped).astype(np.int32) - (((data == 125) | (data == 93)) & ~escaped))
    nesting = nesting - np.concatenate([[0], nesting[:-1]])[start][np.repeat(np.arange(lines), stop - start)]
    free = np.bincount(word_line[plain & (nesting[word_start] <= 0)], minlength=lines)
    markup = lead & (free == 0) & ~((terminals > 0) & (words >= WORDS_PER_ITEM) & (commons >= 2))
    run_stop = np.minimum.accumulate(np.where(~letter, places, size)[::-1])[::-1]
    name_start = np.minimum(first_solid + 1, size - 1)
    name_stop = run_stop[name_start]
    is_item = lead & (name_stop - name_start == 4)
    item = np.zeros(lines, bool)
    item[is_item] = _first_four(data, name_start[is_item]) == _ITEM
    markup &= ~item

    # Delimiters, column edges, and how many of a line's edges the line above has too.
    delimiters = {f"many_{d}": per_line((data == d) & ~escaped) for d, _ in DELIMITERS}
    space = data == 32
    gap_end = np.flatnonzero(space[:-1] & ~space[1:] & np.concatenate([[False], space[:-2]]) & ~feed[1:]) + 1
    gap_line = np.searchsorted(start, gap_end, "right") - 1
    inner = gap_end > first_solid[gap_line]
    gap_end, gap_line = gap_end[inner], gap_line[inner]
    gaps = np.bincount(gap_line, minlength=lines)
    # The far edge of a column's cell is where its run of solid bytes ends.
    edge = np.minimum.accumulate(np.where(~solid, places, size)[::-1])[::-1][np.minimum(gap_end, size - 1)]
    met, last = {}, {}
    for name, place in (("near", gap_end - start[gap_line]), ("far", edge - start[gap_line])):
        key = gap_line * (1 << 20) + np.minimum(place, (1 << 20) - 1)
        above = np.isin(key - (1 << 20), key if prior is None else np.concatenate([prior[f"_last_{name}"], key]))
        met[f"met_{name}"] = np.bincount(gap_line[above], minlength=lines)
        # Keys of the last line, as line -1 of the part that follows.
        last[f"_last_{name}"] = key[gap_line == lines - 1] - lines * (1 << 20)

    # Lists: lines that begin with a marker.
    lead_byte, next_byte = data[first_solid], data[np.minimum(first_solid + 1, size - 1)]
    run_digit = np.minimum.accumulate(np.where(~_DIGIT[data] & (data != 46), places, size)[::-1])[::-1]
    number_stop = np.minimum(run_digit[first_solid], stop - 1)
    numbered = _DIGIT[lead_byte] & (number_stop - first_solid <= 8) & (_BLANK[data[number_stop]] & (before[number_stop] == 46) | (data[number_stop] == 41))
    bullet = np.isin(lead_byte, list(b"-*+")) & _BLANK[next_byte]
    marked = item | ((numbered | bullet) & (solid_all > 0))

    # What a line says but for its blanks and numbers.
    kept = solid & ~(_DIGIT[data] & _DIGIT[before])
    folded = np.where(_DIGIT[data], 48, data)[kept]
    at = np.concatenate([[0], np.cumsum(kept)])
    said = _hashes(folded, at[start], at[stop])

    word_chars = np.concatenate([[0], np.cumsum(begins)])
    word_length = np.bincount(word_line[plain], (word_chars[word_stop] - word_chars[word_start])[plain], lines).astype(np.int64)
    counts = {"start": start, "stop": stop, "code_stop": code_stop, "solid_all": solid_all, "solid_code": solid_code, "letters": letters, "digits": digits, "indent": indent, "width": width, "words": words, "commons": commons, "word_length": word_length, "terminals": terminals, "symbols": per_line(visible & ~letter & ~digit), "gaps": gaps, **delimiters, **met}
    # Places and counts of a part fit four bytes, unless a line is longer than that.
    narrow = np.int32 if size < 2**31 - 1 else np.int64
    return {k: v.astype(narrow) for k, v in counts.items()} | {"closes": closes, "markup": markup, "marked": marked, "said": said} | last


def _first_four(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(4):
        out |= data[np.minimum(at + k, len(data) - 1)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _closed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with a line end after each."""
    data, off = string_bytes(texts)
    own = off + np.arange(len(off))
    out = np.full(own[-1], 10, np.uint8)
    keep = np.ones(own[-1], bool)
    keep[own[1:] - 1] = False
    out[keep] = data
    return out, own


def _measure(texts: pa.Array, common: np.ndarray) -> dict[str, np.ndarray]:
    data, off = _closed(texts)
    n, size = len(off) - 1, len(data)
    if size == n:
        zero = np.zeros(n)
        return {k: np.full(n, "empty") if v == "string" else np.zeros(n, np.int64) if v == "long" else zero.copy() for k, v in STATISTICS.items()}
    text = data.tobytes()
    parts: list[dict[str, np.ndarray]] = []
    if n > 1 or size <= LONG_BYTES:
        parts.append(_line_values(data, off, common, None))
    else:
        base = 0
        for piece in _parts(text):
            values = _line_values(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), common, parts[-1] if parts else None)
            parts.append(values | {k: values[k] + np.int64(base) for k in ("start", "stop", "code_stop")})
            base += len(piece)
    line = {k: np.concatenate([p[k] for p in parts]) for k in parts[0] if k[0] != "_"}
    del parts
    start, code_stop = line["start"].astype(np.int64), line["code_stop"]
    solid_all, solid_code, letters, digits, words, commons, gaps = (line[k] for k in ("solid_all", "solid_code", "letters", "digits", "words", "commons", "gaps"))
    terminals, closes, markup, marked, said = (line[k] for k in ("terminals", "closes", "markup", "marked", "said"))
    doc = np.searchsorted(off, start, "right") - 1
    lines = len(start)

    # Environments without sentences.
    outside = np.ones(lines, bool)
    depth = np.zeros(lines + 1, np.int64)
    open_at: dict[bytes, int] = {}
    current = -1
    hits = [(m.start(), m.group(1) or (b"begin" if m.group(3) == b"iffalse" else b"end"), m.group(2) or b"iffalse") for m in _ENV.finditer(text)]
    hit_lines = np.searchsorted(start, [h[0] for h in hits], "right") - 1 if hits else np.empty(0, int)

    def close_all() -> None:
        for begin in open_at.values():
            depth[begin] += 1
            depth[np.searchsorted(doc, current, "right")] -= 1
        open_at.clear()

    for (where, what, name), at in zip(hits, hit_lines.tolist(), strict=True):
        if where >= code_stop[at] and name != b"iffalse":
            continue
        if doc[at] != current:
            close_all()
            current = doc[at]
        if what == b"begin":
            open_at.setdefault(name, at)
        elif name in open_at:
            depth[open_at.pop(name)] += 1
            depth[at + 1] -= 1
    close_all()
    outside &= np.cumsum(depth)[:-1] == 0

    # Tables: the same number of delimiters, or the same column edges, as the neighbouring line.
    aligned = np.zeros(lines, bool)
    for delimiter, least in DELIMITERS:
        many = line[f"many_{delimiter}"]
        enough = many >= least
        if delimiter in (44, 59):
            enough &= digits + many > 0.5 * solid_code
        same = np.concatenate([[False], (many[1:] == many[:-1]) & enough[1:] & (doc[1:] == doc[:-1])])
        same |= np.concatenate([same[1:], [False]])
        aligned |= _runs(same & enough, doc, ALIGNED_LINES)
    for met in (line["met_near"], line["met_far"]):
        same = (gaps >= 2) & (met >= 0.6 * gaps) & (np.concatenate([[-1], doc[:-1]]) == doc)
        same |= np.concatenate([same[1:], [False]])
        aligned |= _runs(same & (gaps >= 2), doc, ALIGNED_LINES)
    aligned &= commons < np.maximum(3, 0.3 * words)

    # Junk: lines that say the same, but for numbers, as others of their text. A sentence said again stays one.
    filled = np.flatnonzero((solid_all > 0) & ~markup)
    order = filled[np.lexsort((said[filled], doc[filled]))]
    new = np.concatenate([[True], (said[order][1:] != said[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else np.empty(0, bool)
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    repeated = np.zeros(lines, bool)
    repeated[order] = np.repeat(times, times) >= REPEATED_LINES
    repeated &= (terminals == 0) | (digits > 0)

    able = outside & ~markup & ~aligned & ~repeated & (solid_code > 0) & (letters >= 0.4 * solid_code)
    # Lists: runs of lines whose lengths or indents repeat at a lag, and that have few sentence ends.
    run = np.cumsum(np.concatenate([[True], (able[1:] != able[:-1]) | (doc[1:] != doc[:-1])])) - 1
    runs = run[-1] + 1
    run_lines = np.bincount(run, minlength=runs)
    regular = np.maximum(_lagged(line["width"].astype(float), run, runs, LENGTH_LAGS), _lagged(line["indent"].astype(float), run, runs, INDENT_LAGS)) >= REGULAR
    regular &= (run_lines >= REGULAR_LINES) & (np.bincount(run, terminals, runs) < LIST_ENDS * run_lines)
    able &= ~regular[run]

    # Blocks: neighbouring lines that can hold sentences; a marked line is a block of its own.
    new = np.concatenate([[True], (able[1:] != able[:-1]) | (doc[1:] != doc[:-1])]) | marked | np.concatenate([[False], marked[:-1]])
    block = np.cumsum(new) - 1
    total = lambda v: np.bincount(block, v, block[-1] + 1)
    block_words, block_common, block_ends = total(words), total(commons), total(terminals)
    block_solid, block_letters = total(solid_code), total(letters)
    block_marked = total(marked) > 0
    block_closes = total(closes) > 0
    prose = (block_ends > 0) & (block_common >= np.maximum(1, COMMON_SHARE * block_words)) & (block_letters >= LETTER_SHARE * block_solid)
    prose &= np.where(block_marked, (block_words >= WORDS_PER_ITEM) & (block_common >= 2) & block_closes, block_words >= WORDS_PER_SENTENCE * block_ends)
    prose &= block_words >= 4
    sentence_line = able & prose[block]

    by_doc = lambda v: np.bincount(doc, v, n)
    all_solid = by_doc(solid_all)
    filled = solid_all > 0
    lines_filled = by_doc(filled)
    n_words = by_doc(words).astype(np.int64)
    word_length = by_doc(line["word_length"])
    sentence = _ratio(by_doc(np.where(sentence_line, solid_code, 0)), all_solid)
    table_share, list_share = _ratio(by_doc(aligned & filled), lines_filled), _ratio(by_doc(marked & filled), lines_filled)
    repeats = _lagged(line["width"].astype(float), doc, n, LENGTH_LAGS)
    periodic = _lagged(line["indent"].astype(float), doc, n, INDENT_LAGS)
    symbol = by_doc(line["symbols"])
    found = {
        "n_words": n_words, "mean_word_length": _ratio(word_length, n_words), "symbol_share": _ratio(symbol, all_solid), "digit_share": _ratio(by_doc(digits), all_solid),
        "terminal_line_share": _ratio(by_doc(closes & filled), lines_filled), "common_word_share": _ratio(by_doc(commons), n_words), "table_line_share": table_share, "list_line_share": list_share,
        "length_autocorrelation": repeats, "indent_periodicity": periodic, "comment_share": _ratio(by_doc(solid_all - solid_code), all_solid), "sentence_share": sentence, "_solid": all_solid,
    }
    return {k: v for k, v in (found | {"kind": _kind(found)}).items() if k in STATISTICS}


def common_codes(words: list[str]) -> np.ndarray:
    """Sorted hashes of the words in lower case."""
    own = pa.array(sorted({x.lower() for x in words if x}), pa.string())
    data, off = string_bytes(own)
    return np.sort(_hashes(data, off[:-1], off[1:]))


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text", max_words: int = 10_000) -> DataFrame:
    """(id, statistics) of each text, one row per row of ``docs``; a narrow scan without a shuffle.

    ``common_words`` has a column ``word``; it is a fixed list; more than ``max_words`` words raise ValueError. ``sentence_share`` is
    the share of the non-blank characters that stand in sentences of natural language outside comments; ``kind`` is
    ``prose`` from a half on, else ``table``, ``list`` or ``junk``, and ``empty`` for null, empty and blank texts, whose
    shares are 0. Texts are taken whole, whatever their length. Other columns are not read.
    """
    words = [r[0] for r in common_words.select("word").where(F.col("word").isNotNull()).distinct().limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"there are more than {max_words} common words")
    common = common_codes(words)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in passes(batch.column(1)):
                found = measure(batch.column(1).slice(lo, hi - lo), common)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(found[c], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for c, t in STATISTICS.items()]], names=[id_col, *STATISTICS])

    return docs.select(id_col, text).mapInArrow(kernel, f"`{id_col}` {kind}, " + ", ".join(f"{c} {t}" for c, t in STATISTICS.items()))

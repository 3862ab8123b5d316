"""Deeply nested JSON turned into flat tables that keep the links of children to their parents.

The Arrow buffer of the texts is flattened with array operations only: quote parity and bracket depth give the
tokens, a sort by depth gives each token its enclosing container (the parent index), offsets within a container
give the places of list items, and keys reach the children by a vectorised take. A string that holds JSON itself is
unescaped and put in the place of the string, and the text is flattened again. No text is parsed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.operators.buffers import code, codes, last_index, passes, slices, string_bytes

OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST, COLON, COMMA, TEXT, LITERAL, START = range(9)
_KIND = np.full(256, LITERAL, np.int8)
for _byte, _kind in zip(b'{}[]:,"', range(7), strict=True):
    _KIND[_byte] = _kind
_HEX = np.full(256, -1, np.int64)
for _byte in b"0123456789abcdefABCDEF":
    _HEX[_byte] = int(chr(_byte), 16)
_ESCAPED = np.arange(256, dtype=np.uint8)
for _byte, _plain in zip(b"bfnrt", b"\b\f\n\r\t", strict=True):
    _ESCAPED[_byte] = _plain
_CAN_ESCAPE = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
#: What a string that holds JSON begins with; quotes and backslashes are those of strings within strings.
_HOLDS_JSON = r'^(?:[ \t\r\n"]|\\[nrt"\\])*[\[{]'
_LITERAL = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"


@dataclass
class Tokens:
    """The tokens of the complete JSON texts among some rows, in order."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    parent: np.ndarray  # index of the token that opens the enclosing container, -1 at the top
    is_key: np.ndarray
    complete: np.ndarray  # per row
    code: np.ndarray  # of texts up to eight bytes
    off: np.ndarray  # where the rows begin and end in ``data``

    def text(self, index: np.ndarray) -> pa.Array:
        """Unescaped strings (or literals as written) of the tokens at ``index``."""
        return unescape(slices(self.data, self.start[index], self.stop[index]))


def _escapes(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backslashes that begin an escape, and the run of backslashes (begin, end) that each row's come in."""
    runs = np.flatnonzero(data == 92)
    if not len(runs):
        return runs, np.empty((0, 2), np.int64)
    head = np.concatenate([[True], (np.diff(runs) > 1) | (row[runs[1:]] != row[runs[:-1]])])
    begin = runs[head]
    end = np.append(runs[np.flatnonzero(head)[1:] - 1], runs[-1]) + 1
    first = np.repeat(begin, end - begin)
    return runs[(runs - first) % 2 == 0], np.column_stack([begin, end])


def _hex(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of four hexadecimal digits from ``at`` on, or -1."""
    value = np.zeros(len(at), np.int64)
    for k in range(4):
        digit = _HEX[data[np.minimum(at + k, len(data) - 1)]]
        value = np.where((value < 0) | (digit < 0) | (at + k >= len(data)), -1, value * 16 + digit)
    return value


def unescape(raw: pa.Array) -> pa.Array:
    """JSON strings without their escapes; half a surrogate pair becomes a question mark."""
    data, off = string_bytes(raw)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    at, _ = _escapes(data, row)
    if not len(at):
        return raw
    out, keep = data.copy(), np.ones(len(data), bool)
    keep[at] = False
    after = np.minimum(at + 1, len(data) - 1)
    out[after] = _ESCAPED[data[after]]
    at = at[data[after] == 117]
    value = _hex(data, at + 2)
    at, value = at[value >= 0], value[value >= 0]
    high = (value >= 0xD800) & (value < 0xDC00)
    low = (value >= 0xDC00) & (value < 0xE000)
    follows = np.concatenate([(at[1:] == at[:-1] + 6) & (row[at[1:]] == row[at[:-1]]) & low[1:], [False]]) if len(at) else high
    pair = high & follows
    second = np.concatenate([[False], pair[:-1]]) if len(at) else pair
    whole = np.where(pair, 0x10000 + ((value - 0xD800) << 10) + np.append(value[1:], 0) - 0xDC00, value)
    whole = np.where((high & ~pair) | (low & ~second), 63, whole)
    for k in range(6):
        keep[at + k] = False
    at, whole = at[~second], whole[~second]
    size = 1 + (whole > 0x7F) + (whole > 0x7FF) + (whole > 0xFFFF)
    for k in range(4):
        on = size > k
        shift = 6 * (size[on] - 1 - k)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[on]]
        out[at[on] + k] = (whole[on] >> shift) | lead if k == 0 else ((whole[on] >> shift) & 0x3F) | 0x80
        keep[at[on] + k] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(total[off]), pa.py_buffer(np.ascontiguousarray(out[keep]))).cast(raw.type)


def _running(mask: np.ndarray) -> np.ndarray:
    """How often the mask holds before each place, and at the end."""
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])


def tokenize(column: pa.Array) -> Tokens:
    """Tokens of the texts of ``column`` that are complete JSON; other texts give none (see ``complete``)."""
    data, off = string_bytes(column)
    n, size = len(off) - 1, len(data)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    bad = np.zeros(n, bool)

    # A quote after an odd run of backslashes is part of a string. A run ends at the start of a text.
    slash = data == 92
    quote = data == 34
    escapes, runs = _escapes(data, row)
    if len(runs):
        begin, end = runs.T
        after = end[((end - begin) % 2 == 1) & (end < size)]
        quote[after[row[after] == row[after - 1]]] = False
        after = np.minimum(escapes + 1, size - 1)
        wrong = ~_CAN_ESCAPE[data[after]]
        wrong |= (data[after] == 117) & (_hex(data, after + 1) < 0)
        bad[row[escapes[wrong]]] = True
    total = _running(quote)
    bad |= (np.diff(total[off]) & 1).astype(bool)
    quote &= ~bad[row]
    total = _running(quote)
    inside = ((total[1:] - total[off[:-1]][row]) & 1).astype(bool)
    del total
    bad[row[inside & (data < 32)]] = True
    bad[row[slash & ~inside]] = True

    kind = _KIND[data]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    outside = ~inside & ~quote
    literal = outside & (kind == LITERAL) & ~blank
    begins = np.concatenate([[True], row[1:] != row[:-1]]) if size else np.empty(0, bool)
    ends = np.concatenate([begins[1:], [True]]) if size else begins
    before, after = np.concatenate([[False], literal[:-1]]) & ~begins, np.concatenate([literal[1:], [False]]) & ~ends
    first = (outside & (kind < TEXT)) | (quote & inside) | (literal & ~before)
    start = np.flatnonzero(first)
    stop = start + 1
    kind, row = kind[start], row[start]
    stop[kind == LITERAL] = np.flatnonzero(literal & ~after) + 1
    stop[kind == TEXT] = np.flatnonzero(quote & ~inside)
    start = start + (kind == TEXT)

    opens, closes = (kind == OPEN_OBJECT) | (kind == OPEN_LIST), (kind == CLOSE_OBJECT) | (kind == CLOSE_LIST)
    token_off = np.searchsorted(row, np.arange(n + 1))
    depth = np.concatenate([[0], np.cumsum(opens.astype(np.int64) - closes)])
    level = depth[1:] - depth[token_off[:-1]][row]
    bad |= depth[token_off[1:]] != depth[token_off[:-1]]
    np.logical_or.at(bad, row[level < 0], True)
    bad |= np.diff(token_off) == 0
    good = ~bad[row]
    start, stop, kind, row, level, opens, closes = (x[good] for x in (start, stop, kind, row, level, opens, closes))
    count = len(kind)
    token = np.arange(count)

    # Sorted by depth and place, the container of a token is the last opening bracket one level up.
    parent = np.full(count, -1)
    if count:
        member = level - opens + closes
        key = np.concatenate([member * 2 + 1, (level[opens]) * 2])
        who = np.concatenate([token, token[opens]])
        is_mark = np.concatenate([np.zeros(count, bool), np.ones(int(opens.sum()), bool)])
        order = np.lexsort((is_mark, who, key // 2))
        mark = last_index(is_mark[order])
        container = np.where(mark >= 0, who[order][mark], -1)
        real = ~is_mark[order]
        parent[who[order][real]] = container[real]
        parent[member == 0] = -1
    inner = np.where(parent >= 0, kind[parent], START)
    same = np.concatenate([[False], row[1:] == row[:-1]])
    previous = np.where(same, np.concatenate([[START], kind[:-1]]), START)
    following = np.where(np.concatenate([same[1:], [False]]), np.concatenate([kind[1:], [START]]), START)
    is_key = (kind == TEXT) & (following == COLON) & (inner == OPEN_OBJECT)
    key_before = np.concatenate([[False], is_key[:-1]]) & same
    value_end = ((previous == CLOSE_OBJECT) | (previous == CLOSE_LIST) | (previous == LITERAL) | (previous == TEXT)) & ~key_before
    value = (opens | (kind == TEXT) | (kind == LITERAL)) & ~is_key
    fits = np.where(inner == OPEN_OBJECT, previous == COLON, np.where(inner == OPEN_LIST, (previous == OPEN_LIST) | (previous == COMMA), previous == START))
    fits = np.where(is_key, (previous == OPEN_OBJECT) | (previous == COMMA), np.where(value, fits, True))
    fits = np.where(kind == COLON, key_before, fits)
    fits = np.where(kind == COMMA, value_end & (inner != START), fits)
    fits = np.where(closes, (value_end | (previous == kind - 1)) & (inner == kind - 1), fits)
    bad[row[~fits]] = True
    literals = np.flatnonzero(kind == LITERAL)
    if len(literals):
        valid = pc.match_substring_regex(slices(data, start[literals], stop[literals]), _LITERAL).to_numpy(zero_copy_only=False)
        bad[row[literals[~valid]]] = True

    keep = ~bad[row]
    place = np.cumsum(keep) - 1
    parent = np.where(parent >= 0, place[parent], -1)[keep]
    start, stop, kind, row, is_key = (x[keep] for x in (start, stop, kind, row, is_key))
    tokens = Tokens(data, start, stop, kind, row, parent, is_key, ~bad, codes(data, start, stop), off)
    total = _running(slash)
    escaped = np.flatnonzero((kind == TEXT) & (total[stop] > total[start]) & (stop - start <= 48))  # eight characters of six bytes
    if len(escaped):
        plain, at = string_bytes(tokens.text(escaped))
        tokens.code[escaped] = codes(plain, at[:-1], at[1:])
    return tokens


def splice(t: Tokens) -> tuple[np.ndarray, pa.Array]:
    """(rows, texts): the rows with strings that are complete JSON lists or objects, and their texts with these in place of the strings.

    The value of a tag stays a string, whatever it looks like.
    """
    none = np.empty(0, np.int64), pa.array([], pa.large_string())
    lead = t.data[np.minimum(t.start, len(t.data) - 1)] if len(t.data) else t.start
    found = np.flatnonzero((t.kind == TEXT) & ~t.is_key & (t.stop - t.start > 1) & np.isin(lead, list(b'[{\\ "')))
    tags = np.zeros(len(t.kind) + 1, bool)
    key = np.flatnonzero(t.is_key & (t.code == code("tags")))
    tags[key + 2] = True
    holder = t.parent[found]
    found = found[~((holder >= 0) & (tags[holder] | ((t.parent[holder] >= 0) & tags[t.parent[holder]])))]
    if not len(found):
        return none
    raw = slices(t.data, t.start[found], t.stop[found])
    found = found[pc.match_substring_regex(raw, _HOLDS_JSON).to_numpy(zero_copy_only=False)]
    inner = t.text(found).cast(pa.large_string())
    whole = tokenize(inner).complete
    found, inner = found[whole], inner.filter(pa.array(whole))
    if not len(found):
        return none
    plain, at = string_bytes(inner)
    data = np.concatenate([t.data, plain])
    at = at + len(t.data)
    row = t.row[found]
    rows, first, many = np.unique(row, return_index=True, return_counts=True)
    # The pieces of a row: what stands before each string, the string's text, and in the end the rest.
    before = np.concatenate([[0], t.stop[found[:-1]] + 1])
    before[first] = t.off[rows]
    start = np.concatenate([before, at[:-1], t.stop[found[first + many - 1]] + 1])
    stop = np.concatenate([t.start[found] - 1, at[1:], t.off[rows + 1]])
    order = np.lexsort((np.concatenate([np.zeros(len(found)), np.ones(len(found)), np.zeros(len(rows))]), np.concatenate([found, found, np.full(len(rows), len(t.kind))]), np.concatenate([row, row, rows])))
    start, stop = start[order], stop[order]
    ends = np.cumsum(2 * many + 1)
    sizes = np.concatenate([[0], np.cumsum(stop - start)])
    text, _ = string_bytes(slices(data, start, stop))
    return rows, pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.concatenate([[0], sizes[ends]])), pa.py_buffer(np.ascontiguousarray(text)))


def _member(t: Tokens, *names: str) -> np.ndarray:
    """Per token that opens an object: the value of its last key among ``names``, else -1."""
    out = np.full(len(t.kind), -1)
    keys = np.flatnonzero(t.is_key & np.isin(t.code, np.array([code(x) for x in names])))
    out[t.parent[keys]] = keys + 2
    return out


def _integers(t: Tokens, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of numbers, or texts that hold one, at ``index``; other tokens are unknown."""
    known = (index >= 0) & np.isin(t.kind[index], (TEXT, LITERAL))
    values = np.zeros(len(index), np.int64)
    raw = slices(t.data, t.start[index[known]], t.stop[index[known]])
    whole = pc.match_substring_regex(raw, r"^\s*-?[0-9]{1,19}(?:\.0+)?\s*$").to_numpy(zero_copy_only=False)
    number = pc.replace_substring_regex(raw.filter(pa.array(whole)), r"\s+|\.0+\s*$", "")
    # Of 19 digits, those that a BIGINT holds.
    digits = pc.utf8_lpad(pc.replace_substring_regex(number, "^-", ""), 19, "0")
    fits = pc.less_equal(digits, pc.if_else(pc.starts_with(number, "-"), str(2**63), str(2**63 - 1)).cast(digits.type)).to_numpy(zero_copy_only=False)
    number = pc.cast(number.filter(pa.array(fits)), pa.int64())
    where = np.flatnonzero(known)[whole][fits]
    values[where] = number.to_numpy()
    known = np.zeros(len(index), bool)
    known[where] = True
    return values, known


def flatten_ways(column: pa.Array) -> dict[str, dict[str, np.ndarray | pa.Array]]:
    """Flat tables ``ways``, ``tags`` and ``nodes`` of the ways at any depth of the JSON texts; ``row`` links to the text.

    Strings that hold complete JSON count as what they hold, at any depth of strings within strings; such texts
    are flattened again with the strings' content in their place, until none is left.
    """
    levels, own = [], np.arange(len(column))
    while True:
        t = tokenize(column)
        again, column = splice(t)
        flat = _flatten(t)
        for part in flat.values():
            stays = ~np.isin(part["row"], again)
            for name, values in part.items():
                part[name] = values.filter(pa.array(stays)) if isinstance(values, pa.Array) else values[stays]
            part["row"] = own[part["row"]]
        levels.append(flat)
        if not len(again):
            break
        own = own[again]
    if len(levels) == 1:
        return levels[0]
    join = lambda parts: pa.concat_arrays([p.cast(pa.large_string()) for p in parts]) if isinstance(parts[0], pa.Array) else np.concatenate(parts)
    return {k: {c: join([level[k][c] for level in levels]) for c in levels[0][k]} for k in levels[0]}


def _flatten(t: Tokens) -> dict[str, dict[str, np.ndarray | pa.Array]]:
    """The flat tables of the tokens.

    A way is an object of type ``way`` in any case, or without a type in a list under the key ``way``, that has an
    id; a member that only refers to one has none. Nodes may be a list of numbers, of texts or of objects with a
    ``ref``, or one number; tags an object or a list of key and value objects. A null in a list keeps its place.
    """
    count = len(t.kind)
    if not count:
        none, text = np.empty(0, np.int64), pa.array([], pa.string())
        return {"ways": {"row": none, "way_id": none, "n_nodes": none, "highway": text}, "tags": {"row": none, "way_id": none, "tag_key": text, "tag_value": text}, "nodes": {"row": none, "way_id": none, "pos": none, "node_id": none, "highway": text}}
    objects = np.flatnonzero(t.kind == OPEN_OBJECT)
    kind_of, id_of, nodes_of, tags_of = _member(t, "type"), _member(t, "id"), _member(t, "nodes"), _member(t, "tags")
    way = code("way")
    lower = codes(t.data | 32, t.start, t.stop)
    named = (kind_of[objects] >= 0) & (lower[kind_of[objects]] == way) & (t.kind[kind_of[objects]] == TEXT)
    holder = np.where((t.parent[objects] >= 0) & (t.kind[t.parent[objects]] == OPEN_LIST), t.parent[objects], objects)
    label = np.maximum(holder - 2, 0)
    grouped = (kind_of[objects] < 0) & (holder >= 2) & t.is_key[label] & (lower[label] == way)
    ways = objects[(named | grouped) & (id_of[objects] >= 0)]
    way_id, known = _integers(t, id_of[ways])
    ways, way_id = ways[known], way_id[known]
    ordinal = np.full(count, -1)
    ordinal[ways] = np.arange(len(ways))

    value = ~t.is_key & ((t.kind == OPEN_OBJECT) | (t.kind == OPEN_LIST) | (t.kind == TEXT) | (t.kind == LITERAL))

    def items(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item token, index of its list among ``lists``, place from 1) of all items."""
        of = np.full(count, -1)
        of[lists] = np.arange(len(lists))
        item = np.flatnonzero(value & (t.parent >= 0))
        item = item[of[t.parent[item]] >= 0]
        which = of[t.parent[item]]
        order = np.argsort(which, kind="stable")
        item, which = item[order], which[order]
        size = np.bincount(which, minlength=len(lists))
        return item, which, np.arange(len(item)) - (np.cumsum(size) - size)[which] + 1

    # Node references: items of lists, or a single number.
    listed = nodes_of[ways]
    has_list = np.flatnonzero((listed >= 0) & (t.kind[listed] == OPEN_LIST))
    item, which, pos = items(listed[has_list])
    single = np.flatnonzero((listed >= 0) & (((t.kind[listed] == LITERAL) & (t.code[listed] != code("null"))) | (t.kind[listed] == TEXT)))
    item = np.concatenate([item, listed[single]])
    of_way = np.concatenate([has_list[which], single])
    pos = np.concatenate([pos, np.ones(len(single), np.int64)])
    ref = _member(t, "ref", "id")
    target = np.where(t.kind[item] == OPEN_OBJECT, ref[item], item)
    node_id, known = _integers(t, target)

    # Tags: members of an object, or key and value objects in a list.
    tags = tags_of[ways]
    as_object = np.full(count, -1)
    has_object = np.flatnonzero((tags >= 0) & (t.kind[tags] == OPEN_OBJECT))
    as_object[tags[has_object]] = has_object
    key = np.flatnonzero(t.is_key)
    key = key[as_object[t.parent[key]] >= 0]
    has_pairs = np.flatnonzero((tags >= 0) & (t.kind[tags] == OPEN_LIST))
    pair, which_pair, _ = items(tags[has_pairs])
    pair_key, pair_value = _member(t, "k", "key")[pair], _member(t, "v", "value")[pair]
    both = (pair_key >= 0) & (pair_value >= 0)
    tag_way = np.concatenate([as_object[t.parent[key]], has_pairs[which_pair[both]]])
    tag_key, tag_value = np.concatenate([key, pair_key[both]]), np.concatenate([key + 2, pair_value[both]])
    scalar = (t.kind[tag_value] == TEXT) | ((t.kind[tag_value] == LITERAL) & (t.code[tag_value] != code("null")))
    tag_way, tag_key, tag_value = tag_way[scalar], tag_key[scalar], tag_value[scalar]
    values = t.text(tag_value)
    filled = pc.not_equal(pc.utf8_trim_whitespace(pc.fill_null(values, "")), "").to_numpy(zero_copy_only=False)
    road = np.flatnonzero((t.code[tag_key] == code("highway")) & filled)
    highway = np.full(len(ways), -1)
    highway[tag_way[road]] = road
    highways = values.take(pa.array(highway, mask=highway < 0))
    row = t.row[ways]
    return {
        "ways": {"row": row, "way_id": way_id, "n_nodes": np.bincount(of_way, minlength=len(ways)), "highway": highways},
        "tags": {"row": row[tag_way], "way_id": way_id[tag_way], "tag_key": t.text(tag_key), "tag_value": values},
        "nodes": {"row": row[of_way[known]], "way_id": way_id[of_way[known]], "pos": pos[known], "node_id": node_id[known], "highway": highways.take(pa.array(of_way[known]))},
    }


_SCHEMAS = {
    "ways": "way_id long, n_nodes long, highway string",
    "tags": "way_id long, tag_key string, tag_value string",
    "nodes": "way_id long, pos int, node_id long, highway string",
}


def flatten_responses(df: DataFrame, key: str, body: str, table: str) -> DataFrame:
    """One flat table of the ways in the JSON texts ``body``: ``ways``, ``tags`` or ``nodes``, distinct rows under ``key``.

    ``tags`` and ``nodes`` link to ``ways`` by ``key`` and ``way_id``; a way without a road tag has a null
    ``highway``. Null, empty and cut-off texts and texts that are no JSON give no rows. A text fetched again under
    the same key adds only what differs. Only ``key`` and ``body`` are read.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in _SCHEMAS[table].split(", ")]
    types = {"way_id": pa.int64(), "n_nodes": pa.int64(), "pos": pa.int32(), "node_id": pa.int64()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in passes(texts):
                flat = flatten_ways(texts.slice(lo, hi - lo))[table]
                if len(flat["row"]):
                    own = keys.slice(lo, hi - lo).take(pa.array(flat["row"]))
                    rest = [pa.array(flat[x], types[x]) if x in types else pc.cast(flat[x], pa.string()) for x in names]
                    yield pa.RecordBatch.from_arrays([own, *rest], names=[key, *names])

    texts = df.select(key, body).where(F.length(body) > 1)
    return texts.mapInArrow(kernel, f"`{key}` {kind}, {_SCHEMAS[table]}").distinct()

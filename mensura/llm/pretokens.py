"""Where the pre-tokens of byte-level BPE begin, without a regular expression.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is a finite automaton over
classes of code points. Each code point is a function from the state before it to the state after it. Such functions compose
associatively, so a text is cut into lanes: all lanes compose their functions side by side, a scan over the lanes' functions
gives each lane its first state, and a second walk marks the boundaries.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 5  # of a class; BLANK: white space other than the space
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WHITE = frozenset(WHITE)

# Symbols of the automaton. A white-space symbol knows whether a visible character follows it, an apostrophe whether it and
# the next one or two letters are a contraction.
SYM_LETTER, SYM_NUMBER, SYM_OTHER, SPACE_MORE, SPACE_LAST, BLANK_MORE, BLANK_LAST, SHORT, LONG = range(9)
SYMBOLS = 9
# States: what the code point before belongs to. FRESH: nothing that could go on.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) by symbol and state; symbols from ``SYMBOLS`` on begin a text."""
    after = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    begins = np.ones((2 * SYMBOLS, STATES), bool)

    def on(symbol: int, becomes: int, joins: dict[int, int]) -> None:
        after[symbol] = after[symbol + SYMBOLS] = becomes
        for state, goes in joins.items():
            after[symbol, state], begins[symbol, state] = goes, False

    on(SYM_LETTER, IN_LETTERS, {IN_LETTERS: IN_LETTERS, AFTER_SPACE: IN_LETTERS, TWO_LEFT: ONE_LEFT, ONE_LEFT: FRESH})
    on(SYM_NUMBER, IN_NUMBERS, {IN_NUMBERS: IN_NUMBERS, AFTER_SPACE: IN_NUMBERS})
    on(SYM_OTHER, IN_OTHERS, {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS})
    on(SPACE_LAST, AFTER_SPACE, {})
    on(BLANK_LAST, FRESH, {})
    on(SPACE_MORE, IN_WHITE, {IN_WHITE: IN_WHITE})
    on(BLANK_MORE, IN_WHITE, {IN_WHITE: IN_WHITE})
    on(SHORT, ONE_LEFT, {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS})
    on(LONG, TWO_LEFT, {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS})
    return after, begins


AFTER, BEGINS = _automaton()


BLOCK_BITS = 10
_classes = np.full(0x110000, OTHER, np.uint8)
_known = np.zeros(0x110000 >> BLOCK_BITS, bool)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of every code point; a worker looks up those blocks of code points that its texts use."""
    used = np.bincount(points >> BLOCK_BITS, minlength=len(_known)) > 0
    for block in np.flatnonzero(used & ~_known).tolist():
        first = block << BLOCK_BITS
        for c in range(first, first + (1 << BLOCK_BITS)):
            kind = unicodedata.category(chr(c))[0]
            _classes[c] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if c in _WHITE else OTHER
        _known[block] = True
        _classes[0x20] = SPACE
    return _classes[points]


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every code point; ``starts`` are the first code points of texts that are not empty."""
    n = len(points)
    out = classes(points)
    first = np.zeros(n + 3, bool)
    first[starts] = True
    first[n:] = True
    white = out >= SPACE
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = ~white[1:]
    visible_next &= ~first[1 : n + 1]
    out += white & visible_next  # the symbol of white space before a visible character is the next number
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a = np.where(first[quotes + 1], 0, padded[np.minimum(quotes + 1, n)])
        b = np.where(first[quotes + 1] | first[quotes + 2], 0, padded[np.minimum(quotes + 2, n)])
        out[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = a.astype(np.int64) * 0x110000 + b
        out[quotes[np.isin(pair, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])]] = LONG
    out[starts] += SYMBOLS
    return out


def composed(lanes: np.ndarray) -> np.ndarray:
    """The function (state before -> state after) of each lane; ``lanes`` has a row for each step."""
    flat = AFTER.ravel()
    out = np.tile(np.arange(STATES, dtype=np.uint8), (lanes.shape[1], 1))
    for step, row in enumerate(lanes):
        out = flat[(row.astype(np.intp) * STATES)[:, None] + out]
        if out.shape[1] > 1 and step % 16 == 15 and (out == out[:, :1]).all():
            out = out[:, :1]  # every lane ends alike wherever it began
    return np.broadcast_to(out, (lanes.shape[1], STATES)) if out.shape[1] == 1 else out


def scanned(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of functions by doubling: row i is the function of lanes 0 to i."""
    out, step = functions.copy(), 1
    while step < len(out):
        later = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        out = np.concatenate([out[:step], later])
        step *= 2
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of the code points at which pre-tokens begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    length = max(16, int(np.sqrt(n) / 2))
    width = -(-n // length)
    padded = np.full(width * length, SYM_OTHER, np.uint8)
    padded[:n] = symbols(points, starts)
    lanes = np.ascontiguousarray(padded.reshape(width, length).T)
    reached = scanned(composed(lanes))[:, FRESH]
    state = np.concatenate([[FRESH], reached[:-1]]).astype(np.uint8)
    after, begins = AFTER.ravel(), BEGINS.ravel()
    marks = np.empty(lanes.shape, bool)
    for step, row in enumerate(lanes):
        at = row.astype(np.intp) * STATES + state
        marks[step] = begins[at]
        state = after[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def valid(text: bytes | None) -> bytes:
    """The text in valid UTF-8: null is empty, stray bytes become U+FFFD."""
    text = text or b""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def sliced(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """(the pre-tokens of all texts in order, how many each text has)."""
    data = b"".join(texts_ := [t or b"" for t in texts])
    try:
        decoded = data.decode()
        lengths = np.array([len(t) for t in texts_], np.int64)
    except UnicodeDecodeError:
        texts_ = [valid(t) for t in texts_]
        data = b"".join(texts_)
        decoded = data.decode()
        lengths = np.array([len(t) for t in texts_], np.int64)
    if not data:
        return [], np.zeros(len(texts_), np.int64)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths)
    first_bytes = (ends - lengths)[lengths > 0]
    if len(decoded) == len(data):
        at = boundaries(raw, first_bytes)
    else:
        byte_of = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(decoded.encode("utf-32-le"), np.uint32)
        at = byte_of[boundaries(points, np.searchsorted(byte_of, first_bytes))]
    edges = [*at.tolist(), len(data)]
    counts = np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))
    return [data[a:b] for a, b in zip(edges, edges[1:])], counts

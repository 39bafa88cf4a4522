"""Secret scans: fixed patterns, and strings of high entropy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import fenced, without
from stimframe.llm.spans import as_text, by_start, find_spans, overlaps

#: The patterns of the contract, and the condition that a match {m} has to meet.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"length(regexp_extract({m}, '^(?i:password|passwd|secret|token|api_?key)[\"\']?\\x20*[:=]\\x20*[\"\']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length({m}) >= 18"),
    "hex": ("[0-9a-f]{16,}", "true"),
}
#: Strings that may be secrets: runs of the characters of base64 and URL-safe base64. Those shorter than the window are one window of their own.
SHORTEST = 16
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{%d,}+" % SHORTEST
#: Character classes, of which a window has the first that all its characters are in, and the size of the alphabet, from which the least entropy follows.
CLASSES = {"hex": ("0123456789ABCDEFabcdef", 16), "caps": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36), "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 36), "mixed": ("", 62)}
#: The share of windows of random strings that stay under the least entropy.
MISSED = 0.01
#: Candidates that are no secrets however mixed: UUIDs, paths of words. Windows with only digits or none are none either.
ALLOWED = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^/?(?:[A-Za-z_-]++/)++[A-Za-z0-9_-]*+$",
)
#: What placeholders hold, in lower case. Windows with a part of one are no secrets; others of the same candidate may be.
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "0123456789", "abcdefgh")
WINDOW = 20
#: The characters of candidates; their counts in a window take so many bits each, so many of them in a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS, PACKED = 5, 12
#: What a placeholder's characters become.
BLANK = "\x7f"
KINDS = [*PATTERNS, "entropy"]
ADDED = ("n_assign", "n_access", "n_hex", "base", "added")


@lru_cache
def least_entropy(size: int, window: int) -> float:
    """Bits that all but MISSED of the random strings of so many characters of an alphabet of that size reach; from 20,000 drawn with a fixed seed."""
    drawn = np.sort(np.random.default_rng(8).integers(0, size, (20_000, window)), axis=1)
    run = np.ones(len(drawn))
    total = np.zeros(len(drawn))  # of c * log2(c)
    for k in range(1, window + 1):
        same = drawn[:, k] == drawn[:, k - 1] if k < window else np.zeros(len(drawn), bool)
        total += np.where(same, 0, run * np.log2(run))
        run = np.where(same, run + 1, 1)
    return float(np.floor(np.quantile(np.log2(window) - total / window, MISSED) * 1e4) / 1e4)


def _groups() -> str:
    """SQL for an array of what each code adds to the packed counts of a window: characters outside the first three classes, digits, blanks."""
    kinds = [lambda c, own=own: c not in own for own, _ in list(CLASSES.values())[:3]] + [str.isdigit, lambda c: c == BLANK]
    return "array(" + ", ".join(f"{sum(int(f(c)) << COUNT_BITS * k for k, f in enumerate(kinds))}" for c in ALPHABET + BLANK) + ")"


def _highest_entropy(window: int) -> str:
    """SQL for the largest entropy of the windows of s.w characters of a candidate, for each class in turn, from the numbers s.codes of its characters.

    An array of one value for each of CLASSES: that of its windows with some digits, some other characters and no blank; NULL if there is none.
    The counts of the window's characters are packed in longs, COUNT_BITS for each, and those of _groups() in one more number. A step lets one character in and, once
    the window is full, one out; f(c) is c * log2(c), and the smallest sum of f so far gives the largest entropy.
    """
    f = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    gains = "array(" + ", ".join(f"{f[c + 1] - f[c]!r}D" for c in range(window + 1)) + ")"  # f(c + 1) - f(c)
    word, shift = (lambda code: f"({code} div {PACKED})"), (lambda code: f"(cast({code} % {PACKED} as int) * {COUNT_BITS})")
    none = f"array_repeat(0L, {-(-(len(ALPHABET) + 1) // PACKED)})"
    held = lambda code: f"cast(shiftright(st.counts[{word(code)}], {shift(code)}) & {(1 << COUNT_BITS) - 1} as int)"
    one = lambda code, k: f"if({word(code)} = {k}, shiftleft(1L, {shift(code)}), 0L)"
    n_of = lambda k: f"(shiftright(t.groups, {COUNT_BITS * k}) & {(1 << COUNT_BITS) - 1})"
    entered = f"struct(transform(st.counts, (x, k) -> x + {one('n', 'k')}) as counts, st.total + {gains}[{held('n')}] as total, st.groups + {_groups()}[n] as groups)"
    first = f"aggregate(slice(s.codes, 1, s.w), struct({none} as counts, 0D as total, 0 as groups), (st, n) -> {entered})"
    kind = f"case when {n_of(4)} > 0 or {n_of(3)} = 0 or {n_of(3)} = s.w then -1 when {n_of(0)} = 0 then 0 when {n_of(1)} = 0 then 1 when {n_of(2)} = 0 then 2 else 3 end"
    # The least sum so far of each class; only that of the window's class may change.
    noted = lambda t, least: f"transform(array({t}), t -> struct(t.counts as counts, t.total as total, t.groups as groups, transform({least}, (y, k) -> if(k = {kind}, least(coalesce(y, t.total), t.total), y)) as least))[0]"
    moved = (
        f"struct(transform(st.counts, (x, k) -> x - {one('d.o', 'k')} + {one('d.n', 'k')}) as counts,"
        f" st.total - {gains}[{held('d.o')} - 1] + {gains}[if(d.o = d.n, {held('d.n')} - 1, {held('d.n')})] as total,"
        f" st.groups - {_groups()}[d.o] + {_groups()}[d.n] as groups)"
    )
    step = f"case when d.o = d.n then st else {noted(moved, 'st.least')} end"
    moves = "zip_with(s.codes, slice(s.codes, s.w + 1, greatest(size(s.codes) - s.w, 0)), (o, n) -> struct(o, n))"
    begun = noted(first, f"array_repeat(cast(null as double), {len(CLASSES)})")
    slid = f"aggregate(filter({moves}, d -> d.n is not null), {begun}, (st, d) -> {step}, st -> st.least)"
    return f"transform({slid}, x -> log2(double(s.w)) - x / s.w)"


def scan_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), and base and added: arrays of struct(kind, start, stop, m), by start.

    base has the matches of PATTERNS. added has the candidate strings one of whose windows of `window` characters (or which, if
    shorter, as a whole) reach the Shannon entropy that 99 % of random strings of the window's character class and that length reach,
    unless a pattern of `allowed` suppresses the candidate or a base span overlaps it. Windows without a digit, of digits alone, and those with a part of
    one of PLACEHOLDERS don't count; so a key behind a name or a path is judged by its own characters, and a chance match in a long string hides no more than the windows about it. A
    window slides by one character: counts of the leaving and the entering one change, and with them the sum of
    c * log2(c) from which the entropy follows, so that the work grows with a candidate's length alone. window is at most
    31. Null text counts as empty; repeated rows get equal results; an empty table gives an empty result; columns with an
    added name are replaced. No shuffle.
    """
    if not 1 < window < 1 << COUNT_BITS:
        raise ValueError(f"a window has 2 to {(1 << COUNT_BITS) - 1} characters, not {window}")
    df = without(docs, [*ADDED, "__t", "__c", "__base"]).withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    for kind, (pattern, keep) in PATTERNS.items():
        df = find_spans(df, "__t", kind, pattern, f"__s_{kind}", "AKIA" if kind == "access" else None, keep)
    df = find_spans(df, "__t", "entropy", CANDIDATE, "__c")
    allow = " and ".join(f"not s.m rlike '{p}'" for p in allowed)
    sizes = range(min(SHORTEST, window), window + 1)
    limits = "array(" + ", ".join(f"element_at(array({', '.join(f'{least_entropy(n, w)}D' for w in sizes)}), s.w - {sizes[0] - 1})" for _, n in CLASSES.values()) + ")"
    masked = "s.m"
    for p in PLACEHOLDERS:
        masked = f"regexp_replace({masked}, '(?i){p}', '{BLANK * len(p)}')"
    masked = f"if(s.m rlike '(?i){'|'.join(PLACEHOLDERS)}', {masked}, s.m)"
    found = (
        df.withColumn("base", F.expr(by_start(f"concat({', '.join(f'__s_{k}' for k in PATTERNS)})", KINDS)))
        .withColumns({f"n_{k}": F.size(f"__s_{k}").cast("long") for k in PATTERNS})
        .withColumn("__c", F.expr(f"filter(__c, s -> {allow} and not ({' or '.join(overlaps(f'__s_{k}', 's') for k in PATTERNS)}))"))
        .withColumn("__c", F.expr(f"transform(__c, s -> struct(s.kind, s.start, s.stop, s.m, least({window}, length(s.m)) as w, transform(split({masked}, ''), a -> instr('{ALPHABET + BLANK}', a) - 1) as codes))"))
        .withColumn("added", F.expr(f"transform(filter(__c, s -> exists(zip_with({_highest_entropy(window)}, {limits}, (h, l) -> coalesce(h >= l, false)), x -> x)), s -> struct(s.kind, s.start, s.stop, s.m))"))
        .drop("__t", "__c", *[f"__s_{k}" for k in PATTERNS])
    )
    return fenced(found, ADDED)


def digest(found: DataFrame) -> DataFrame:
    """found with base_sha256 and spans."""
    return found.withColumn("base_sha256", F.sha2(F.expr(as_text("base")).cast("binary"), 256)).withColumn("spans", F.expr(as_text(by_start("concat(base, added)", KINDS))))

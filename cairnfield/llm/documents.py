"""Statistics of whole texts, vectorised over batches; shared by the quality operators."""

from __future__ import annotations

import numpy as np

from cairnfield.llm.common import Texts, grams, mix, sums

SYMBOLS = b"#*$%&|<>"
#: Ratios of a text that the models read, in this order.
RATIOS = ("log_words", "word_len", "long_words", "symbols", "digits", "upper", "marks", "stops", "commas", "bars", "non_ascii", "dup_lines", "dup_words", "repeat3", "same_next", "top_word", "line_words", "shout")


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it occurs, and whether an equal one stands earlier."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    count, later = np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    count[order] = np.bincount(group, minlength=1)[group] if len(s) else 0
    later[order] = ~new
    return count, later


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return h ^ mix(doc.astype(np.uint64) + np.uint64(0x51ED27))


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    b, doc = t.buf, t.docs_of_words()
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    out = {"n_words": t.n_words.astype(np.int64), "word_chars": sums(~t.blank & ((b & 0xC0) != 0x80), t.at), "n_symbols": sums(symbol[b] if len(b) else np.zeros(0, bool), t.at)}
    # Lines end at \n; each text's last one at the \n laid after it.
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    full = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(t.at, starts, "right") - 1
    _, later = _repeats(_own(t.spans(starts, ends), line_doc))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=len(t.n_words)).astype(np.int64)
    out["n_lines"] = np.bincount(line_doc, minlength=len(t.n_words)).astype(np.int64)
    h = t.word_hashes()
    g = grams(h, 3)
    ok = np.flatnonzero(doc[: len(g)] == doc[2:]) if len(g) else np.zeros(0, np.int64)
    count, _ = _repeats(_own(g[ok], doc[ok]))
    hit = np.zeros(len(h) + 3, bool)
    for k in range(3):
        hit[ok[count > 1] + k] = True
    out["n_repeat_words"] = sums(hit[: len(h)], t.first)
    out["hashes"] = h
    return out


def ratios(t: Texts, base: dict[str, np.ndarray]) -> np.ndarray:
    """The columns named in RATIOS, float32; an empty text has zeros."""
    b, doc, n = t.buf, t.docs_of_words(), len(t.n_words)
    words, chars = np.maximum(t.n_words, 1), np.maximum(base["word_chars"], 1)
    share = lambda mask: sums(mask, t.at) / chars
    size = t.ends - t.starts
    h = base["hashes"]
    count, later = _repeats(_own(h, doc))
    top = np.zeros(n)
    np.maximum.at(top, doc, count)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper = (b >= 65) & (b <= 90)
    run = np.concatenate(([0], np.cumsum(upper)))
    shout = (run[t.ends] - run[t.starts]) >= 2
    cols = [
        np.log1p(t.n_words), base["word_chars"] / words, sums(size > 20, t.first) / words, base["n_symbols"] / chars, share((b >= 48) & (b <= 57)), share(upper),
        share((b == 33) | (b == 63)), share(b == 46), share(b == 44), share(b == 124), share(b >= 192), base["n_dup_lines"] / np.maximum(base["n_lines"], 1),
        sums(later, t.first) / words, base["n_repeat_words"] / words, sums(same, t.first) / words, top / words, np.log1p(t.n_words / np.maximum(base["n_lines"], 1)), sums(shout, t.first) / words,
    ]
    return np.stack(cols, 1).astype(np.float32)

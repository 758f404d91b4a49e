"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

``base_spans`` finds emails, IP addresses, card and phone numbers by their definitions. The tagger adds what these miss
(national phone numbers, "name at host dot org", bracketed, dashed or spaced forms, IPv6): it is trained from generated sentences whose spans are known by
construction, reads overlapping windows of WINDOW characters, decodes each by Viterbi under the tag constraints, and the windows'
spans are reconciled over the whole text: base spans stay, spans that a window cuts are read across windows laid together, and of
overlapping ones the surest wins. A tagged span must also hold its kind's shape, and is cut to it (``SHAPES``, ``plausible``).

``model_spans`` runs the network over every window. As of its spans only those stay that hold a plausible shape, ``find_spans`` takes the
windows where such a span can be: every shape holds one of few marks (``PLACES``: an at sign or word before a name and a dot, three dots or
colons between numbers, ten digits with separators), which are looked for in the whole text. The windows with a mark are run, and from them
those before and behind, as long as a tag reaches over (``near``), so that spans of any length are read whole and none is lost.

Cases: null and empty texts have no spans; a null doc_id, repeated rows and extra columns pass through; offsets count code
points, the end is exclusive; very long texts are read in windows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import ip_address
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._common import steps

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. An email's local part is found by going left from its at sign, which keeps long runs linear; a number that
#: fails at the start of a run of digits fails within it too, so an address starts where no digit is before it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
#: The words "at" and "dot" with a name between them, which is 253 characters long at most.
SPELLED = re.compile(r"\bat\b[\s\])}>]{0,4}[\w.-]{1,253}[\s\[({<]{1,4}dot\b", re.I)
WINDOW, STRIDE = 96, 48
#: Windows of one matrix product and products at once (their states stay in a core's cache), windows that are cut from texts at once.
LANES, GROUPS, PART = 256, 2, 4096
CHARS, EMBED, HIDDEN, TAGS = 130, 14, 24, 1 + 2 * len(KINDS)
#: Shapes of what the tagger may add. An at sign or a dot may be spelled, in brackets or apart.
AT_SIGN, DOT_SIGN = r"(?:@|\s@\s|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)", r"(?:\.|\s\.\s|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
#: It can only begin where a name does, and gives nothing of a name back, so that a long name without an address is read once.
EMAIL_SHAPE = re.compile(rf"(?<![\w.%+-])[\w.%+-]++(?:{DOT_SIGN}[\w.%+-]++)*{AT_SIGN}[\w-]+(?:{DOT_SIGN}[\w-]+)*{DOT_SIGN}[a-z]{{2,24}}", re.I | re.A)
IP_SHAPE = re.compile(rf"([0-9]{{1,3}}){DOT_SIGN}([0-9]{{1,3}}){DOT_SIGN}([0-9]{{1,3}}){DOT_SIGN}([0-9]{{1,3}})", re.I)
CARD_SHAPE = re.compile(r"[0-9](?:[\x20._/-]{0,3}[0-9])+")
PHONE_SHAPE = re.compile(r"\(?\+?[0-9][0-9()\x20./-]*[0-9]")

#: Marks, one at least in whatever has a kind's shape and is plausible, at any cut of the text around it (what is looked at before or
#: behind a mark is within the shape): the sign of an address, the first dot or colons of an IP address, the digits of a number.
PLACES = (
    re.compile(rf"@(?=(?:\s?[\])}}>]\s?|\s)?[\w-]++(?i:{DOT_SIGN})[\w-])", re.A),
    re.compile(rf"[Aa][Tt](?<=[\s\[({{<]..)(?=(?:\s?[\])}}>]\s?|\s)[\w-]++(?i:{DOT_SIGN})[\w-])", re.A),
    re.compile(rf"[0-9](?=(?i:{DOT_SIGN}[0-9]{{1,3}}{DOT_SIGN}[0-9]{{1,3}}{DOT_SIGN})[0-9])"),
    re.compile(r":(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)"),
    re.compile(r"[0-9](?:[()\x20._/-]*+[0-9]){9,}+"),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base patterns, sorted."""
    out = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                end = m.end()
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: (text, [(start, kind's index, end)])."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = "an er in on re th st en ed ou ti lo ma ve sa ch ei gu es que mento lich jo ha ck wil son dr ph ty".split()
    plain = "the a we you contact me please write to call is was at on mail and or for of my us our number phone server from reach or send it card paid with host address dial tel fax then dot until".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def text_word() -> str:
        return pick([word, word, lambda: pick(plain), lambda: pick(plain), lambda: word().capitalize(), lambda: word() + "ción"])()

    def name() -> str:
        """A name in an address."""
        one = lambda: pick([word, word, lambda: pick(letters) + word(), lambda: "".join(pick(letters) for _ in range(int(rng.integers(1, 25)))), lambda: pick(letters) * int(rng.integers(2, 60)) if rng.random() < 0.3 else word(), lambda: word() + number(int(rng.integers(1, 4))), lambda: word().capitalize()])()
        return pick([one, one, lambda: f"{one()}{pick('._-')}{one()}"])()

    def card(gaps: list[str]) -> str:
        body = number(int(rng.integers(13, 17)))
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick(gaps)
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def spelled() -> str:
        """An address with its signs in words, brackets or apart."""
        end = pick(["com", "org", "net", "de", "io", "edu", "co.uk", "info", "fr"])
        at, dot = pick([(" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" {at} ", " {dot} "), (" <at> ", " <dot> "), (" AT ", " DOT "), (" (at) ", "."), (" [at] ", "."), (" at ", "."), (" @ ", " . "), ("[@]", "."), (" @ ", "."), ("@", "[.]"), ("@", " dot "), (" At ", " Dot ")])
        host = dot.join([name().replace(".", ""), *([word()] if rng.random() < 0.2 else []), *end.split(".")])
        return name().replace(".", dot if rng.random() < 0.5 else ".") + at + host

    def made(kind: int) -> str:
        if kind == 0:
            return pick([lambda: f"{name()}@{word()}.{pick(['com', 'org', 'net', 'de'])}", spelled, spelled, spelled])()
        if kind == 1:
            parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
            return pick([lambda: ".".join(parts), lambda: "[.]".join(parts), lambda: " . ".join(parts), lambda: "(.)".join(parts), lambda: " dot ".join(parts), lambda: "[dot]".join(parts), lambda: ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8)), lambda: f"2001:db8:{int(rng.integers(0, 65536)):x}::{int(rng.integers(0, 65536)):x}", lambda: f"fe80::{int(rng.integers(0, 65536)):x}:{int(rng.integers(0, 65536)):x}:{int(rng.integers(0, 65536)):x}"])()
        if kind == 2:
            return card(["", " ", "-", ".", "/", "  ", " - ", "_"])
        return pick([lambda: f"+{number(2)} {number(3)} {number(7)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"({number(3)}) {number(3)} {number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"{number(3)} {number(3)} {number(4)}", lambda: f"0{number(3)} {number(3)} {number(4)}", lambda: f"0{number(2)} {number(4)} {number(4)}", lambda: f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", lambda: f"00{number(2)} {number(2)} {number(4)} {number(4)}", lambda: f"1-{number(3)}-{number(3)}-{number(4)}", lambda: f"0{number(3)}/{number(3)}-{number(4)}", lambda: f"+{number(1)}-{number(3)}-{number(3)}-{number(4)}", lambda: f"(0{number(2)}) {number(4)} {number(4)}"])()

    def other() -> str:
        return pick([lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2030)} {number(2)}.{number(2)}", lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d} {number(2)}:{number(2)}:{number(2)}", lambda: f"{rng.integers(1900, 2030)} - {rng.integers(1900, 2030)}", lambda: f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"${number(3)}.{number(2)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"version {number(1)}.{number(2)}.{number(4)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: number(int(rng.integers(1, 12))), lambda: f'token = "{rng.bytes(20).hex()}"', lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"{number(3)},{number(3)},{number(3)},{number(3)}", lambda: f"meet at {word()}", lambda: f"{word()} at {word()} {number(2)}", lambda: f"a dot at {word()} {word()}", lambda: f"look at {word()} and dot {word()}", lambda: f"page {number(2)} of {number(3)}", lambda: number(int(rng.integers(20, 30))), lambda: f"{number(3)}.{number(3)}", lambda: f"AKIA{rng.bytes(8).hex().upper()}", lambda: f"https://{word()}.com/{number(5)}", lambda: f"order {number(4)}-{number(4)}", lambda: f"{number(2)} {number(2)} {number(2)}", lambda: f"section {number(1)}.{number(1)}.{number(1)}", lambda: f"std::{word()}{number(1)}", lambda: f"@{word()}{number(2)}"])()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 7))):
            text += " ".join(text_word() for _ in range(int(rng.integers(1, 6)))) + pick([" ", " ", " ", ": ", ". ", ", ", "\n", "### ", " = ", " ("])
            roll = rng.random()
            if roll < 0.5:
                kind = int(rng.integers(len(KINDS)))
                value = made(kind)
                spans.append((len(text), kind, len(text) + len(value)))
                text += value + pick([" ", ". ", ", ", "\n", "$$$ ", ") "])
            elif roll < 0.85:
                text += other() + pick([" ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, other letters one class; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.minimum(points, 128).astype(np.int64) + 1


def tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), dtype=np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def allowed() -> np.ndarray:
    """0 where one tag may follow another, else -1e4: inside follows only begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS), dtype=np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def run_lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, reverse: bool, keep: bool = False):
    """Hidden states (steps, windows, HIDDEN) of inputs (steps, windows, EMBED)."""
    steps_, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
    out, tape = np.zeros((steps_, n, HIDDEN), dtype=np.float32), []
    fed = x @ w + b
    for t in range(steps_ - 1, -1, -1) if reverse else range(steps_):
        z = fed[t] + h @ u
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            tape.append((t, i, f, o, g, tc, *before))
    return out, tape


def lstm_grads(tape: list, x: np.ndarray, d_out: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, dtype=np.float32), np.zeros_like(x)
    dh_next = dc_next = 0
    for t, i, f, o, g, tc, h0, c0 in reversed(tape):
        dh = d_out[t] + dh_next
        dc = dh * o * (1 - tc * tc) + dc_next
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += h0.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w.T
        dh_next, dc_next = dz @ u.T, dc * f
    return dw, du, db, dx


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_grads(emit: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood in emissions (steps, windows, TAGS) and transitions."""
    steps_, n, _ = emit.shape
    fore, back = np.empty_like(emit), np.zeros_like(emit)
    fore[0] = emit[0]
    for t in range(1, steps_):
        fore[t] = emit[t] + log_sum(fore[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps_ - 2, -1, -1):
        back[t] = log_sum(trans[None] + (emit[t + 1] + back[t + 1])[:, None, :], 2)
    total = log_sum(fore[-1], 1)
    d_emit = np.exp(fore + back - total[None, :, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, steps_):
        d_trans += np.exp(fore[t - 1][:, :, None] + trans[None] + (emit[t] + back[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    w = np.arange(n)
    for t in range(steps_):
        d_emit[t, w, tags[t]] -= 1
    np.subtract.at(d_trans, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return d_emit, d_trans


def prepared(model: dict) -> tuple[np.ndarray, ...]:
    """The trained weights as ``emissions`` takes them: recurrent, input and bias weights of each direction in one matrix, the logistic
    gates by tanh ((1 + tanh(x / 2)) / 2; states are held doubled), the outputs as differences to the tag outside of spans."""
    gate = np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])[:, None]
    weights = np.stack([np.concatenate([u * np.float32(0.5), w, b[None]]).T * gate for w, u, b in (model["left"], model["right"])])
    out, bias = (model["out"] - model["out"][:, :1]).T[1:] * np.float32(0.5), (model["bias"] - model["bias"][0])[1:, None]
    return np.ascontiguousarray(model["embed"].T), weights[:, None], np.stack([out[:, :HIDDEN], out[:, HIDDEN:]])[:, None], bias


def buffers(groups: int, lanes: int) -> list[np.ndarray]:
    """What ``emissions`` works in, for groups of lanes: inputs of both directions, gates, cells, tanh of cells, outputs, characters."""
    sizes = (HIDDEN + EMBED + 1,), (4 * HIDDEN,), (HIDDEN,), (HIDDEN,)
    return [*(np.ones((2, groups, *size, lanes), dtype=np.float32) for size in sizes), np.empty((2, WINDOW, groups, TAGS - 1, lanes), dtype=np.float32), np.empty((EMBED, WINDOW, groups, lanes), dtype=np.float32)]


def emissions(ready: tuple[np.ndarray, ...], held: list[np.ndarray], window: np.ndarray, emit: np.ndarray) -> None:
    """Sets ``emit`` (WINDOW, TAGS - 1, windows), for character classes (windows, WINDOW), to each tag's score less that of the tag
    outside of spans. Both directions and all groups take a step at once."""
    embed, weights, outs, bias = ready
    fed, z, c, tc, out, x = held
    groups, lanes = z.shape[1], z.shape[3]
    filled = np.zeros((WINDOW, groups * lanes), dtype=np.intp)
    filled[:, : len(window)] = window.T
    np.take(embed, filled.reshape(WINDOW, groups, lanes), axis=1, out=x, mode="clip")  # all classes are in the table; this mode takes without a copy
    x = x.transpose(1, 2, 0, 3)
    h, left, right = fed[:, :, :HIDDEN], fed[0, :, HIDDEN:-1], fed[1, :, HIDDEN:-1]
    i, f, o, g = (z[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    logistic = z[:, :, : 3 * HIDDEN]
    h[:], c[:] = 0, 0
    for t in range(WINDOW):
        left[:], right[:] = x[t], x[WINDOW - 1 - t]
        np.matmul(weights, fed, out=z)
        np.tanh(z, out=z)
        logistic += np.float32(1)
        c *= f
        i *= g
        c += i
        c *= np.float32(0.5)
        np.multiply(o, np.tanh(c, out=tc), out=h)
        np.matmul(outs, h, out=out[:, t])
    for k in range(groups):
        part = emit[:, :, k * lanes : (k + 1) * lanes]
        n = part.shape[2]
        np.add(out[0, :, k, :, :n], out[1, ::-1, k, :, :n], out=part)
        part += bias


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (windows, steps); no window's text starts inside a span unless cut there. What ``allowed`` forbids is not tried."""
    steps_, n, _ = emit.shape
    emit, score = emit.transpose(0, 2, 1), np.empty((steps_, TAGS, n), dtype=emit.dtype)
    score[0] = emit[0]
    outside = score[0, 0].copy()
    free = [0, *range(1, TAGS, 2)]  # what any tag may go before; inside of a kind comes only behind its begin and itself
    into, begun, inside = trans[:, free, None], np.diag(trans, 1)[1::2, None], np.diag(trans)[2::2, None]
    best, other, within = np.empty((len(free), n), dtype=emit.dtype), np.empty((len(free), n), dtype=emit.dtype), np.empty((len(KINDS), n), dtype=emit.dtype)
    for t in range(1, steps_):
        before, now = score[t - 1], score[t]
        outside = emit[t, 0] + (outside + trans[0, 0])
        np.add(before[0], into[0], out=best)
        for k in range(1, TAGS):
            np.maximum(best, np.add(before[k], into[k], out=other), out=best)
        np.add(before[1::2], begun, out=within)
        np.maximum(within, np.add(before[2::2], inside, out=other[1:]), out=within)
        np.add(emit[t, 0], best[0], out=now[0])
        np.add(emit[t, 1::2], best[1:], out=now[1::2])
        np.add(emit[t, 2::2], within, out=now[2::2])
    tags = np.zeros((n, steps_), dtype=np.int64)
    # Only paths that are better than staying outside of spans are followed back.
    better = np.flatnonzero(score[-1].max(axis=0) > outside)
    score = score[:, :, better]
    own = np.empty((steps_, len(better)), dtype=np.int64)
    own[-1] = score[-1].argmax(axis=0)
    for t in range(steps_ - 1, 0, -1):
        own[t - 1] = (score[t - 1] + trans[:, own[t]]).argmax(axis=0)
    tags[better] = own.T
    return tags


@lru_cache(maxsize=2)
def train(sentences: int = 3000, epochs: int = 7, batch: int = 128, seed: int = 11) -> dict:
    """The tagger; about ten seconds, once a driver process."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, spans in generated(sentences, seed):
        code, tags = codes(text), tagged(text, spans)
        for at in range(0, max(1, len(code) - STRIDE), STRIDE):
            part, t = code[at : at + WINDOW], tags[at : at + WINDOW].copy()
            xs.append(np.pad(part, (0, WINDOW - len(part))))
            ys.append(np.pad(t, (0, WINDOW - len(t))))
    x, y = np.array(xs), np.array(ys)
    make = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
    gate = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    p = {"embed": make(CHARS, EMBED) * 4, "lw": make(EMBED, 4 * HIDDEN), "lu": make(HIDDEN, 4 * HIDDEN), "lb": gate.copy(), "rw": make(EMBED, 4 * HIDDEN), "ru": make(HIDDEN, 4 * HIDDEN), "rb": gate.copy(), "out": make(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, dtype=np.float32), "trans": np.zeros((TAGS, TAGS), dtype=np.float32)}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    wall, turn = allowed(), 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            turn += 1
            ids = order[at : at + batch]
            bx, by = x[ids], y[ids].T
            e = p["embed"][bx.T]
            left, tl = run_lstm(e, p["lw"], p["lu"], p["lb"], False, True)
            right, tr = run_lstm(e, p["rw"], p["ru"], p["rb"], True, True)
            h = np.concatenate([left, right], axis=2)
            # A window may begin inside a span, so its first tag is free; later ones obey the wall.
            d_emit, d_trans = crf_grads(h @ p["out"] + p["bias"], by, p["trans"] + wall)
            d_emit /= len(ids)
            d_h = d_emit @ p["out"].T
            dlw, dlu, dlb, dxl = lstm_grads(tl, e, d_h[:, :, :HIDDEN], p["lw"], p["lu"])
            drw, dru, drb, dxr = lstm_grads(tr, e, d_h[:, :, HIDDEN:], p["rw"], p["ru"])
            d_embed = np.zeros_like(p["embed"])
            np.add.at(d_embed, bx.T, dxl + dxr)
            flat = h.reshape(-1, 2 * HIDDEN)
            grads = {"embed": d_embed, "lw": dlw, "lu": dlu, "lb": dlb, "rw": drw, "ru": dru, "rb": drb, "out": flat.T @ d_emit.reshape(-1, TAGS), "bias": d_emit.sum(axis=(0, 1)), "trans": d_trans / len(ids)}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = 0.02 * (1 - turn / (total + 1)) + 0.001
            for k, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return {"embed": p["embed"], "left": (p["lw"], p["lu"], p["lb"]), "right": (p["rw"], p["ru"], p["rb"]), "out": p["out"], "bias": p["bias"], "trans": p["trans"] + wall}


def windows(text: str) -> list[int]:
    """Starts of the windows around digits, at signs and the words "at ... dot". The tagger reads all windows, not only these."""
    last = max(0, len(text) - STRIDE - 1) // STRIDE
    out: set[int] = set()
    spelled = SPELLED.finditer(text) if "dot" in text.lower() else ()
    for m in chain(TRIGGER.finditer(text), spelled):
        at = m.start() // STRIDE
        wide = m.re is SPELLED  # the name before it and the end behind it belong to it
        out.update(w for w in range(at - 1 - wide, m.end() // STRIDE + 1 + wide) if 0 <= w <= last)
        if at > last:
            out.add(last)
    return [w * STRIDE for w in sorted(out)]


AT = re.compile(AT_SIGN, re.I | re.A)
SHAPES = (EMAIL_SHAPE, re.compile(rf"{IP_SHAPE.pattern}|[0-9a-f:]{{7,}}", re.I), CARD_SHAPE, PHONE_SHAPE)


def plausible(kind: int, value: str) -> bool:
    """Whether what has the shape of its kind, which is wider than the base pattern, may be of it."""
    digits = "".join(c for c in value if c.isdigit() and c.isascii())
    if kind == 0:
        return True
    if kind == 1:
        if ":" in value:
            try:
                return value.count(":") > 2 and bool(ip_address(value))
            except ValueError:
                return False
        parts = IP_SHAPE.fullmatch(value)
        return parts is not None and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(re.findall(r"[() ./-]+", value)) >= 2 and value.count("(") == value.count(")")


def found(tags: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sureness, start, kind's index, end) of the spans of one tag sequence that ends in the tag outside of spans, as columns.

    A span is a begin with what is inside of its kind, or what is inside of a kind with nothing before it."""
    before = np.concatenate([[0], tags[:-1]]).astype(tags.dtype)
    even, tagged_ = tags % 2 == 0, tags > 0
    more = even & tagged_ & ((before == tags) | (before + 1 == tags))  # goes on with what is before it
    start, stops = np.flatnonzero(tagged_ & (~even | (before == 0))), np.flatnonzero(~more)
    end = stops[np.searchsorted(stops, start) + 1]
    sums = np.add.reduceat(gap, np.stack([start, end], axis=1).ravel())[::2] if len(start) else gap[:0]
    return sums / (end - start), start, (tags[start].astype(np.int64) - 1) // 2, end


def runs(tags: np.ndarray, gap: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
    """(sureness, start, kind's index, end) of the spans of one tag sequence."""
    columns = found(np.append(tags, 0), np.append(gap, 0))
    return zip(*(x.tolist() for x in columns), strict=True)


def read(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of all texts in order: (the texts' numbers, the windows' starts, character classes (windows, WINDOW)), PART or more
    windows at a time. A window begins every STRIDE characters, the last one reaches its text's end."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, text in enumerate(texts):
        n = -(-max(len(text) - STRIDE, 1) // STRIDE) if text else 0
        for first in range(0, n, PART):
            m = min(PART, n - first)
            code = codes(text[first * STRIDE : (first + m + 1) * STRIDE]).astype(np.uint8)
            blocks = np.pad(code, (0, (m + 1) * STRIDE - len(code))).reshape(m + 1, STRIDE)
            held.append((np.full(m, k), np.arange(first, first + m) * STRIDE, np.concatenate([blocks[:-1], blocks[1:]], axis=1)))
            if sum(len(x[0]) for x in held) >= PART:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def best(model: dict, window: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a tagged character, their tags, their gaps (rows, WINDOW)) of windows' character classes; each goes through the network."""
    ready, n = prepared(model), len(window)
    held, emit = buffers(0, 0), np.zeros((WINDOW, TAGS, n), dtype=np.float32)
    for at in range(0, n, GROUPS * LANES):
        size = min(GROUPS * LANES, n - at)
        lanes = -(-size // GROUPS)
        if held[0].shape[3] != lanes:
            held = buffers(GROUPS, lanes)
        emissions(ready, held, window[at : at + size], emit[:, 1:, at : at + size])
    tags = viterbi(emit.transpose(0, 2, 1), model["trans"])
    tags[np.arange(WINDOW) >= sizes[:, None]] = 0
    rows = np.flatnonzero(tags.any(axis=1))
    tags = tags[rows]
    gaps = np.take_along_axis(emit[:, :, rows].transpose(2, 0, 1), tags[:, :, None], 2)[:, :, 0]
    return rows, tags.astype(np.uint8), gaps


def decoded(model: dict, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The windows that hold a tagged character, in order: (the texts' numbers, the windows' starts, their sizes, tags and gaps (windows,
    WINDOW)), some at a time. Every window goes through the network."""
    lengths = np.array([len(t) for t in texts])
    for ks, ats, window in read(texts):
        sizes = np.minimum(WINDOW, lengths[ks] - ats)
        rows, tags, gaps = best(model, window, sizes)
        yield ks[rows], ats[rows], sizes[rows], tags, gaps


def marked(text: str, n: int) -> np.ndarray:
    """Which of a text's n windows hold some of a mark, in order."""
    spans = [m.span() for place in PLACES for m in place.finditer(text)]
    if not spans:
        return np.empty(0, dtype=np.int64)
    first, end = np.array(spans).T
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.clip(first // STRIDE - 1, 0, n - 1), 1)
    np.add.at(change, np.minimum((end - 1) // STRIDE, n - 1) + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]))


def near(model: dict, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``decoded`` gives, but only of windows with a mark, and of those next to a window that is run and has a tag where the two
    are laid together: a run of tags that holds a mark is whole, and no run is cut.

    Windows have numbers in order over all texts. PART of the marked ones are taken at a time; these with their neighbours reach as far as
    ``reach``, over whose end no tag goes, so that the next ones start behind it."""
    lengths, edge = np.array([len(t) for t in texts], dtype=np.int64), STRIDE // 2
    counts = np.where(lengths > 0, -(-np.maximum(lengths - STRIDE, 1) // STRIDE), 0)
    ends = np.cumsum(counts)
    wanted = np.concatenate([np.empty(0, dtype=np.int64), *(marked(t, n) + end - n for t, n, end in zip(texts, counts.tolist(), ends.tolist(), strict=True))])
    reach = -1
    for first in range(0, len(wanted), PART):
        held, known = [], np.empty(0, dtype=np.int64)
        new = wanted[first : first + PART]
        new = new[new > reach]
        while len(new):
            ks = np.searchsorted(ends, new, side="right")
            before = new - ends[ks] + counts[ks]  # of its text
            ats = before * STRIDE
            sizes = np.minimum(WINDOW, lengths[ks] - ats)
            window = codes("".join(texts[k][at : at + WINDOW].ljust(WINDOW, "\0") for k, at in zip(ks.tolist(), ats.tolist(), strict=True))).astype(np.uint8).reshape(-1, WINDOW)
            window[np.arange(WINDOW) >= sizes[:, None]] = 0
            rows, tags, gaps = best(model, window, sizes)
            held.append((new[rows], ks[rows], ats[rows], sizes[rows], tags, gaps))
            known = np.union1d(known, new)
            left = (before[rows] > 0) & (tags[:, edge] > 0)
            right = (before[rows] < counts[ks[rows]] - 1) & (tags[:, WINDOW - edge - 1] > 0)
            new = np.setdiff1d(np.concatenate([new[rows][left] - 1, new[rows][right] + 1]), known)
            new = new[new > reach]
        if held:
            reach = int(known[-1])
            order, *part = map(np.concatenate, zip(*held, strict=True))
            yield tuple(x[np.argsort(order)] for x in part)


def model_spans(model: dict, texts: list[str], margin: float = 0.0, shaped: bool = False) -> list[list[tuple[float, int, int, int]]]:
    """(sureness, start, kind's index, end) for each text; if ``shaped``, all of those that hold a plausible shape, and not all others.

    Spans that a window sees whole come from that window. Besides, overlapping windows are laid together: each character has the tag
    of the window that it is in the middle of, so that spans of any length, at any place, are read across windows."""
    out: list[set] = [set() for _ in texts]
    lengths, edge = np.array([len(t) for t in texts]), STRIDE // 2

    def put(columns: tuple[np.ndarray, ...], keep: np.ndarray, ks: np.ndarray, starts: np.ndarray) -> None:
        """The kept spans; ``starts``: where they begin in their texts."""
        sure, start, kind, end = columns
        keep &= sure >= margin
        for k, *span in zip(*(x[keep].tolist() for x in (ks, sure, starts, kind, starts + end - start)), strict=True):
            out[k].add(tuple(span))

    def whole(ks: np.ndarray, ats: np.ndarray, sizes: np.ndarray, tags: np.ndarray, gaps: np.ndarray) -> None:
        """Spans that begin and end in their window."""
        width = WINDOW + 1
        columns = _, start, _, end = found(*(np.pad(x, ((0, 0), (0, 1))).ravel() for x in (tags, gaps)))
        row, a = np.divmod(start, width)
        b = a + end - start
        keep = ((a > 0) | (ats[row] == 0)) & ((b < sizes[row]) | (ats[row] + sizes[row] == lengths[ks[row]])) & (tags[row, a] % 2 == 1)
        put(columns, keep, ks[row], ats[row] + a)

    def laid(ks: np.ndarray, ats: np.ndarray, sizes: np.ndarray, tags: np.ndarray, gaps: np.ndarray) -> None:
        """Spans of the windows laid together: of each its middle, of a text's first and last one what is before and behind it too. A
        window that is not here has no tag, so that a column of the tag outside stands for it."""
        apart = np.concatenate([[True], (ks[1:] != ks[:-1]) | (ats[1:] != ats[:-1] + STRIDE)])
        at = np.arange(-1, WINDOW)
        own = (at >= np.where(ats == 0, 0, edge)[:, None]) & (at < np.where(ats + sizes == lengths[ks], sizes, WINDOW - edge)[:, None])
        own[:, 0] = apart
        row, column = np.nonzero(own)
        columns = _, start, _, _ = found(*(np.append(np.pad(x, ((0, 0), (1, 0)))[own], x.dtype.type(0)) for x in (tags, gaps)))
        put(columns, np.ones(len(start), dtype=bool), ks[row[start]], ats[row[start]] + column[start] - 1)

    rest: tuple[np.ndarray, ...] | None = None  # the last windows, whose spans may go on
    for part in (near if shaped else decoded)(model, texts):
        whole(*part)
        part = part if rest is None else tuple(map(np.concatenate, zip(rest, part, strict=True)))
        closed = np.flatnonzero(part[3][:, WINDOW - edge - 1] == 0)
        n = closed[-1] + 1 if len(closed) else 0
        if n:
            laid(*(x[:n] for x in part))
        rest = tuple(x[n:] for x in part)
    if rest is not None and len(rest[0]):
        laid(*rest)
    return [sorted(x) for x in out]


def reconcile(text: str, base: list[tuple[int, int, int]], found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """All spans of one text, sorted: the base ones, and tagged ones that overlap none, the surest first."""
    out, taken = list(base), bytearray(len(text))
    edge = lambda p: not (0 < p < len(text)) or not (text[p - 1].isalnum() and text[p].isalnum())
    for start, _, end in base:
        taken[start:end] = b"\1" * (end - start)
    for _, first, kind, last in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
        # What a tagged span has before or behind the shape of its kind is no part of it.
        value = text[first:last]
        shaped = SHAPES[kind].search(value) if kind or AT.search(value) else None
        if shaped is None:
            continue
        start, end = first + shaped.start(), first + shaped.end()
        if edge(start) and edge(end) and plausible(kind, shaped[0]) and taken.find(1, start, end) < 0:
            out.append((start, kind, end))
            taken[start:end] = b"\1" * (end - start)
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_spans(docs: DataFrame, model: dict, text: str = "text", spans: str = "spans", base: str = "base", redacted: str | None = None) -> DataFrame:
    """``docs`` with the columns ``base`` and ``spans`` (kind:start:end, comma-joined; the second with the tagger's), or, if
    ``redacted`` is given, with that column instead: the text with each span replaced by its kind in brackets."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    names = [redacted] if redacted else [base, spans]

    def covered(value: str, found: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for start, kind, end in found:
            if start >= done:
                out += [value[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            values = batch.column(at).to_pylist()
            texts = [v or "" for v in values]
            bases = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
            spans_ = [reconcile(t, b, f) for t, b, f in zip(texts, bases, model_spans(held.value, texts, shaped=True), strict=True)]
            if redacted:
                new = [[None if v is None else covered(v, s) for v, s in zip(values, spans_, strict=True)]]
            else:
                new = [[joined(b) for b in bases], [joined(s) for s in spans_]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(n, pa.string()) for n in new)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, StringType()) for n in names)]))


def report(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the numbers count base spans."""
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), model)
    count = lambda kind: F.regexp_count("base", F.lit(f"(^|,){kind}:")).cast(LongType()).alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def fingerprint(text: str) -> str:
    """What ``report`` gives as base_sha256."""
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()

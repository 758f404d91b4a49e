import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from promptloom.llm import pii

from .cases import documents, frame
from .pii_sentences import CASES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"ab@. 1290+-()é", "a.b@c.de", "4111 1111 1111 1111", "10.0.0.1", "+44 20 7946 0958", "@x.y"]), max_size=16).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_held_out_sentences():
    made = pii.generated(200, 123)
    found = pii.model_spans(pii.train(), [t for t, _ in made])
    right = missed = wrong = 0
    for (text, spans), tagged in zip(made, found, strict=True):
        got = set(pii.reconcile(text, pii.base_spans(text), tagged))
        right += len(got & set(spans))
        missed += len(set(spans) - got)
        wrong += len(got - set(spans))
    assert right / (right + missed) > 0.85 and wrong / (right + wrong) < 0.05


def test_tagger_adds_what_the_patterns_miss_across_windows():
    model = pii.train()
    for lead in range(0, 130, 7):
        text = "lorem ipsum " * 12
        text = text[:lead] + " call (415) 555-2671 now. " + text
        spans = pii.reconcile(text, pii.base_spans(text), pii.model_spans(model, [text])[0])
        start = text.index("(415)")
        assert (start, 3, start + 14) in spans, lead


def test_sentences_that_no_generator_made():
    found = pii.model_spans(pii.train(), [t for t, _ in CASES])
    right = missed = wrong = added = 0
    for (text, want), tagged in zip(CASES, found, strict=True):
        base = pii.base_spans(text)
        spans = pii.reconcile(text, base, tagged)
        got = {(pii.KINDS[k], text[a:b]) for a, k, b in spans}
        assert set(base) <= set(spans)
        added += len(spans) - len(base)
        right, missed, wrong = right + len(got & set(want)), missed + len(set(want) - got), wrong + len(got - set(want))
    assert right / (right + missed) > 0.75 and wrong / (right + wrong) < 0.05 and added >= 18


def test_long_spans_are_found_at_every_offset():
    model, found = pii.train(), 0
    name = "x" * 50 + " at example dot org"
    texts = ["lorem ipsum dolor " * 8 + "a" * lead + " write to " + name + " now. " + "dolor sit amet " * 9 for lead in range(1, 97, 5)]
    for text, tagged in zip(texts, pii.model_spans(model, texts), strict=True):
        start = text.index(name)
        found += (start, 0, start + len(name)) in pii.reconcile(text, [], tagged)
    assert found >= 0.8 * len(texts)


def test_spans_read_across_windows():
    import numpy as np

    tags, gap = np.array([0, 1, 2, 2, 0, 2, 2, 7, 8]), np.arange(9.0)
    assert list(pii.runs(tags, gap)) == [(2.0, 1, 0, 4), (5.5, 5, 0, 7), (7.5, 7, 3, 9)]


def test_windows_without_a_trigger_are_not_run():
    assert pii.windows("no digits in here " * 100) == []
    text = "x" * 500 + "7" + "x" * 500
    assert all(any(at <= p < at + pii.WINDOW for at in pii.windows(text)) for p in (500,))


def test_viterbi_obeys_the_constraints():
    import numpy as np

    emit = np.random.default_rng(1).normal(0, 3, (30, 8, pii.TAGS)).astype(np.float32)
    for row in pii.viterbi(emit, pii.train()["trans"]):
        for a, b in zip(row, row[1:], strict=False):
            assert b == 0 or b % 2 == 1 or a in (b, b - 1)


def test_crf_gradient_by_differences():
    import numpy as np

    rng = np.random.default_rng(2)
    emit, trans, tags = rng.normal(size=(4, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (4, 2))

    def loss(e, t):
        fore = e[0]
        for k in range(1, 4):
            fore = e[k] + pii.log_sum(fore[:, :, None] + t[None], 1)
        gold = sum(e[k, w, tags[k, w]] for k in range(4) for w in range(2)) + sum(t[tags[k, w], tags[k + 1, w]] for k in range(3) for w in range(2))
        return pii.log_sum(fore, 1).sum() - gold

    d_emit, d_trans = pii.crf_grads(emit, tags, trans)
    for at in [(0, 0, 1), (2, 1, 3), (3, 0, 0)]:
        up, down = emit.copy(), emit.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((loss(up, trans) - loss(down, trans)) / 2e-5 - d_emit[at]) < 1e-4
    for at in [(0, 1), (3, 4)]:
        up, down = trans.copy(), trans.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((loss(emit, up) - loss(emit, down)) / 2e-5 - d_trans[at]) < 1e-4


def test_report(spark):
    rows = [*documents(), (70, "mail a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111 or +44 20 7946 0958"), (71, "é\U0001f600 x@y.zz")]
    got = pii.report(frame(spark, rows), pii.train()).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), hashlib.sha256(pii.joined(plain(t or "")).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    one = next(r for r in got if r.doc_id == 70)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1) and one.spans.startswith("email:5:13")
    assert next(r for r in got if r.doc_id == 71).spans == "email:3:9"
    assert pii.report(frame(spark, []), pii.train()).collect() == []


def test_redaction(spark):
    df = pii.find_spans(frame(spark, [(1, "to a@b.cd!"), (2, None), (3, "")]), pii.train(), redacted="clean")
    assert {r.doc_id: r.clean for r in df.collect()} == {1: "to [EMAIL]!", 2: None, 3: ""}


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "1.." * 100_000, "0" * 9000 + ".1.1.999", "+" * 100_000, "@" * 100_000):
        assert pii.base_spans(text) == []


def test_windows_without_a_trigger_are_read_too():
    model, name = pii.train(), "y" * 300 + " (at) example (dot) org"
    for value, text in [("john (at) example.org", "lorem ipsum dolor sit amet " * 9 + "write to john (at) example.org now. " + "dolor sit amet " * 9), ("vetist at quedrph.tylo.org", "please mail vetist at quedrph.tylo.org or write"), (name, "please write to " + name + " today")]:
        start = text.index(value)
        assert (start, 0, start + len(value)) in pii.reconcile(text, pii.base_spans(text), pii.model_spans(model, [text])[0]), value
    assert pii.windows("please mail vetist at quedrph.tylo.org or write") == []


def test_all_windows_are_cut_from_texts(monkeypatch):
    monkeypatch.setattr(pii, "PART", 3)
    texts = ["", "a", *("".join(chr(97 + (k * k + n) % 26) for k in range(n)) for n in (47, 48, 49, 96, 97, 143, 144, 145, 500, 1000))]
    got = [(k, at, tuple(w)) for ks, ats, ws in pii.read(texts) for k, at, w in zip(ks.tolist(), ats.tolist(), ws.tolist(), strict=True)]
    want = []
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - pii.STRIDE, 1), pii.STRIDE) if text else ():
            part = pii.codes(text[at : at + pii.WINDOW]).tolist()
            want.append((k, at, tuple(part + [0] * (pii.WINDOW - len(part)))))
    assert got == want


def plain_spans(model, text):
    """Of every window by the definitions: the network gate by gate, the best path over all tags, characters by the window they are in the middle of."""
    import numpy as np

    starts, out = list(range(0, max(len(text) - pii.STRIDE, 1), pii.STRIDE)), set()
    batch = np.zeros((len(starts), pii.WINDOW), dtype=np.int64)
    for row, at in enumerate(starts):
        code = pii.codes(text[at : at + pii.WINDOW])
        batch[row, : len(code)] = code
    x = model["embed"][batch.T]
    states = [pii.run_lstm(x, *model[side], reverse=side == "right")[0] for side in ("left", "right")]
    emit = np.concatenate(states, axis=2) @ model["out"] + model["bias"]
    laid, gaps = np.zeros(len(text), dtype=int), np.zeros(len(text))
    for row, at in enumerate(starts):
        score, back = emit[0, row], []
        for t in range(1, pii.WINDOW):
            every = score[:, None] + model["trans"]
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + emit[t, row]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        size = min(pii.WINDOW, len(text) - at)
        tags = np.array(path[::-1])[:size]
        gap = emit[np.arange(size), row, tags] - emit[:size, row, 0]
        out |= {(at + a, k, at + b) for _, a, k, b in pii.runs(tags, gap) if (a > 0 or at == 0) and (b < size or at + size == len(text)) and tags[a] % 2 == 1}
        first = pii.STRIDE // 2 if at else 0
        laid[at + first : at + size], gaps[at + first : at + size] = tags[first:], gap[first:]
    return out | {(a, k, b) for _, a, k, b in pii.runs(laid, gaps)}


def test_spans_are_those_of_all_windows():
    made = [t for t, _ in pii.generated(60, 5)]
    texts = [*made[:20], *(" ".join(made[k : k + 8]) for k in range(20, 60, 8)), "1" * 400, "no digits in here " * 30, "x" * 97]
    found = pii.model_spans(pii.train(), texts)
    assert [{f[1:] for f in x} for x in found] == [plain_spans(pii.train(), t) for t in texts]


def test_spans_go_on_from_part_to_part(monkeypatch):
    made = [t for t, _ in pii.generated(24, 9)]
    texts = [" ".join(made), "", "write to " + "x" * 400 + " (at) example (dot) org or " + "1" * 600 + ". " + made[0], "a b " * 300, *made[:5]]
    want = [plain_spans(pii.train(), t) if t else set() for t in texts]
    for part in (1, 3, 4096):
        monkeypatch.setattr(pii, "PART", part)
        assert [{f[1:] for f in x} for x in pii.model_spans(pii.train(), texts)] == want, part


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", ".", "_", "%", "-", "+", " ", "@", " at ", "(at)", " [AT] ", " dot ", "[.]", " . ", "(dot)", "org", "x.y", "\u00e9"]), max_size=14).map("".join))
def test_address_shape_is_that_of_its_parts(text):
    wide = re.compile(rf"[\w.%+-]+(?:{pii.DOT_SIGN}[\w.%+-]+)*{pii.AT_SIGN}[\w-]+(?:{pii.DOT_SIGN}[\w-]+)*{pii.DOT_SIGN}[a-z]{{2,24}}", re.I | re.A)
    one, other = wide.search(text), pii.EMAIL_SHAPE.search(text)
    assert (one and one.span()) == (other and other.span()) and (one is None or pii.AT.search(text))


def test_long_tagged_runs_stay_linear():
    import time

    began = time.process_time()
    assert pii.reconcile("x" * 100_000, [], [(1.0, 0, 0, 99_996)]) == []
    assert pii.reconcile("x" * 100_000 + " at y", [], [(1.0, 0, 0, 100_005)]) == []
    many = "a@b.de " * 20_000
    base = pii.base_spans(many)
    assert pii.reconcile(many, base, [(1.0, s, k, e) for s, k, e in base]) == base
    assert time.process_time() - began < 20


PIECES = ["a", "B9", "_", "%", "-", "+", " ", " ", "@", " at ", "(at)", " [AT] ", "at", " dot ", "[.]", " . ", "(Dot)", ".", "/", ":", "::", "(", ")", "org", "x.y", "é", "12", "7", "192", "2001", "db8", "415 555", "4111 1111 1111 1111", "1.2.3.4"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_whatever_is_plausible_holds_a_mark(text):
    marks = {p for place in pii.PLACES for m in place.finditer(text) for p in range(*m.span())}
    for first in range(len(text)):
        for last in range(first + 1, len(text) + 1):
            for kind, shape in enumerate(pii.SHAPES):
                m = shape.search(text[first:last])
                if m and pii.plausible(kind, m[0]):
                    assert marks & set(range(first + m.start(), first + m.end())), (text, m[0])


def test_spans_near_marks_are_those_of_all_windows(monkeypatch):
    made = [t for t, _ in pii.generated(60, 17)]
    plain_, name = "lorem ipsum dolor sit amet " * 20, "y" * 900 + " (at) example (dot) org"
    texts = [*made[:20], *(plain_.join(made[k : k + 5]) for k in range(20, 60, 5)), *(t for t, _ in CASES), "", "a", plain_]
    texts += [plain_ + name + " " + plain_, name, plain_ + "1" * 600 + " 415 555 2671 " * 40, *(plain_[:lead] + "call (415) 555-2671 or john (at) example.org" for lead in range(40, 150, 9))]
    model = pii.train()
    for bias in (0, 2, 4):  # what tags more has longer runs over more windows
        eager = model | {"bias": model["bias"] + np.float32(bias) * (np.arange(pii.TAGS) > 0)}
        spans = lambda found: [pii.reconcile(t, pii.base_spans(t), f) for t, f in zip(texts, found, strict=True)]  # noqa: B023, E731
        monkeypatch.setattr(pii, "PART", 4096)
        every = pii.model_spans(eager, texts)
        assert bias or any(len(s) > len(pii.base_spans(t)) for s, t in zip(spans(every), texts, strict=True))
        for part in (1, 3, 4096):
            monkeypatch.setattr(pii, "PART", part)
            some = pii.model_spans(eager, texts, shaped=True)
            assert all({f[1:] for f in s} <= {f[1:] for f in e} for s, e in zip(some, every, strict=True))
            assert spans(some) == spans(every), (bias, part)


def test_windows_that_can_hold_no_span_are_not_run(monkeypatch):
    run, text = [], "lorem ipsum at dolor 2024, sit amet. " * 400
    text += "call (415) 555-2671 now. " + text
    monkeypatch.setattr(pii, "best", lambda model, window, sizes, whole=pii.best: run.append(len(window)) or whole(model, window, sizes))
    found = pii.model_spans(pii.train(), [text], shaped=True)[0]
    start = text.index("(415)")
    assert pii.reconcile(text, pii.base_spans(text), found) == [(start, 3, start + 14)] and sum(run) <= 5


def test_marks_stay_linear():
    import time

    began = time.process_time()
    for text in ("1" + " " * 500_000, "1 " * 500_000, "@" * 500_000, "@" + "a" * 500_000, " at" * 200_000, ":" * 500_000, "1." * 300_000, "1234567" * 50_000, ("1" + " " * 50_000) * 9):
        pii.marked(text, -(-(len(text) - pii.STRIDE) // pii.STRIDE))
    assert time.process_time() - began < 20

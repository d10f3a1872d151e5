import hashlib
import random
import re
import time

import pytest

from marquee.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for _ in range(20000):
        signs = rng.choice(["ab.@-1", "0123456789.", "0123456789 -+()", "1.2 @a+-", "٣1.2"])
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1 " * 500000, "@" * 10**6, "a@" * 500000, "+1" * 500000, "1." * 500000, "+1" + " " * 10**6, "a@b." * 200000])
def test_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    pii.base_spans(text)
    list(pii.windows(text))
    assert time.process_time() - began < 10


def bodies():
    rng = random.Random(3)
    out = []
    for k in range(160):
        name, n = rng.choice(["ann", "bob.k", "c_dee"]), rng.randint(100, 999)
        card = f"4{rng.randint(10**13, 10**14 - 1)}"
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        out.append("We met and spoke of " + rng.choice([
            f"mail to {name}{n}@mail{k}.example.com for more", f"host {rng.randint(1, 255)}.{n % 256}.{k}.7 is down", f"card {card} was used",
            f"call +1 ({n}) 555-{1000 + k} now", f"order {rng.randint(10**15, 10**16 - 1)} was sent", f"the year {1900 + k % 100} and {n} others"]) + " on that day.")
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.train([e for t in bodies() for e in pii.examples(t)])


@pytest.mark.parametrize(("text", "want"), [
    ("call me at (640) 555-0953 today", [("phone", "(640) 555-0953")]), ("ip 10[.]20[.]30[.]40 down", [("ip", "10[.]20[.]30[.]40")]),
    ("write to joe [at] mail [dot] org now", [("email", "joe [at] mail [dot] org")]), ("mail bob.smith at example dot com please", [("email", "bob.smith at example dot com")]),
    ("on 2024-05-17 we met", []), ("it cost 1 250 000 dollars", []), ("we met at home. John said", []), ("nothing here", []), ("", [])])
def test_added_spans(weights, text, want):
    assert [(k, text[a:b]) for a, b, k in pii.added_spans(text, pii.base_spans(text), weights)] == want


@pytest.mark.parametrize(("kind", "s"), [("email", "bob.k@mail.example.com"), ("ip", "192.168.10.12"), ("ip", "10.20.30.40"), ("card", "4111111111111111"), ("phone", "+16405550953")])
def test_every_rewritten_form_has_a_window(kind, s):
    for pick in range(20):
        for form in pii.variants(kind, s, pick):
            for text in (form, f"so {form}\nand more"):
                at = text.index(form)
                assert any(a <= at and at + len(form) <= b for a, b in pii.windows(text)), form
    assert list(pii.windows("10 dot 20 dot 30 dot 40"))


@pytest.mark.parametrize("form", ["192[dot]168[dot]10[dot]12", "10(dot)20(dot)30(dot)40"])
def test_an_address_is_found_whatever_else_the_text_holds(weights, form):
    for more in ("", " or write to a@b.co", " since 1999-12-31"):
        text = f"ip {form} is down{more}"
        assert ("ip", form) in [(k, text[a:b]) for a, b, k in pii.added_spans(text, pii.base_spans(text), weights)]


def test_best_labelling_equals_trying_all(weights):
    text = "tel 640-555-0953 or ann (at) mail.org, 10[.]2[.]3[.]4 and 4111.1111.1111.1111"
    w = pii.Window(text, 0, len(text))
    chosen = pii.best(w, weights)
    score = {(i, k, kind): pii.score_of(weights, f) for i, k, kind, f in w.segments}
    parts = sorted(score)

    def most(at):
        return max([0.0, *(score[s] + most(s[0] + s[1]) for s in parts if s[0] >= at)])

    assert sum(score[s] for s in chosen) == pytest.approx(most(0)) and len(chosen) >= 3


def test_gradient_is_that_of_the_likelihood(weights):
    text = "tel 640-555-0953 or ann (at) mail.org"
    w = pii.Window(text, 0, len(text))
    gold = {pii.best(w, weights)[0]}

    def likelihood(wt):
        score = [(i, k, kind, pii.score_of(wt, f)) for i, k, kind, f in w.segments]

        def total(at):
            return 1 + sum(pii.np.exp(s) * total(i + k) for i, k, _, s in score if i >= at)

        return sum(s for i, k, kind, s in score if (i, k, kind) in gold) - pii.np.log(total(0))

    g = pii.gradient(w, gold, weights)
    for name in sorted(g)[:8]:
        up, down = ({**weights, name: weights.get(name, 0.0) + e} for e in (1e-5, -1e-5))
        assert g[name] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=1e-3)


def test_rows(docs, edge_pairs):
    pairs = edge_pairs + list(enumerate(bodies(), 1000)) + [(50, "4111111111111111 a@b.co a@b.co +12 345 678 90 1.2.3.4")]
    df = docs(pairs, more=("spans", "n_email"))
    got = pii.find(df, pii.fit(df)).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got if r.doc_id is not None) == sorted(
        (i, *(sum(s[2] == k for s in plain(t or "")) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in plain(t or "")).encode()).hexdigest())
        for i, t in pairs if i is not None)
    texts = dict(pairs)
    for r in got:
        if r.doc_id is not None and r.doc_id not in (5, 13):
            assert set(r.spans.split(",")) >= {f"{k}:{a}:{b}" for a, b, k in plain(texts[r.doc_id] or "")}


def test_mask(docs, edge_pairs):
    df = docs([(1, "mail a@b.co or +12 345 678 90."), (2, None), (3, "")], more=("_text",))
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(df, {}).collect()}
    assert got == {1: ("mail [email] or [phone].", 24), 2: (None, None), 3: ("", 0)}
    assert pii.mask(df, {}).columns == df.columns


def test_nothing_to_learn_from(docs):
    df = docs([(1, "no data"), (2, None)])
    assert pii.fit(df) == {} and pii.fit(df.where("doc_id > 5")) == {}
    assert pii.find(df.where("doc_id > 5"), {}).collect() == []


def _mixed(size, seed=1):
    rng = random.Random(seed)
    out, n = [], 0
    while n < size:
        out.append(rng.choice([f"bob{rng.randint(0, 99)}@mail.example.com ", f"+1 (555) 123-{rng.randint(0, 9999):04d} ", f"10.{rng.randint(0, 255)}.3.4 ", "4111 1111 1111 1111 ", f"call 555-123-{rng.randint(0, 9999):04d} ", "word "]))
        n += len(out[-1])
    return "".join(out)


def test_added_spans_and_masks_take_time_in_proportion():
    weights = {"phone:bias": 1.0, "email:bias": 1.0}
    times = []
    for size in (30_000, 240_000):
        text = _mixed(size)
        t = time.perf_counter()
        assert pii.added_spans(text, pii.base_spans(text), weights)
        pii.masked(text, weights)
        times.append(time.perf_counter() - t)
    assert times[1] < 24 * times[0] + 0.5


def test_taken_spans_against_all():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        taken = pii.Taken(spans)
        a = rng.randint(0, 45)
        b = a + rng.randint(1, 6)
        assert taken.overlaps(a, b) == any(x < b and a < y for x, y in spans)
        assert taken.holds(a, b) == any(x <= a and b <= y for x, y in spans)


def test_long_written_out_addresses_are_one_span():
    weights = {"email:end 3": 1.0}
    for address in ("first.last [at] cs [dot] dept [dot] example [dot] org", "bob (at) cs (dot) dept (dot) example (dot) org", "averylongname" * 7 + ".last at example dot com"):
        text = f"please write {address} today"
        assert [(text[a:b], k) for a, b, k in pii.added_spans(text, [], weights)] == [(address, "email")]

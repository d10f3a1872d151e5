import hashlib
import re

import xxhash

from marquee.llm import edit_sketch as es

P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
ALL = (1 << 64) - 1


def rot(v, n):
    return (v << n | v >> (64 - n)) & ALL


def final(h):
    h = (h ^ h >> 33) * P2 & ALL
    h = (h ^ h >> 29) * P3 & ALL
    return h ^ h >> 32


def hash_long(x, seed):
    h = (seed + P5 + 8) & ALL ^ rot((x & ALL) * P2 & ALL, 31) * P1 & ALL
    return final((rot(h, 27) * P1 + P4) & ALL)


def hash_int(x, seed):
    h = (seed + P5 + 4) & ALL ^ (x & 0xFFFFFFFF) * P1 & ALL
    return final((rot(h, 23) * P2 + P3) & ALL)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute(text):
    units = [xxhash.xxh64_intdigest(m.encode(), 42) for m in re.findall(r"[ \t\n\x0b\f\r]{0,8}[^ \t\n\x0b\f\r]{1,16}|[ \t\n\x0b\f\r]{1,8}", text or "")]
    if not units:
        return "0000" * 64
    seen, kmers = {}, []
    for i in range(max(1, len(units) - 2)):
        h = 42
        for v in units[i : i + 3]:
            h = hash_long(v, h)
        k = signed(h) >> 24
        o = seen[k] = seen.get(k, -1) + 1
        kmers.append((signed(hash_int(o, hash_long(k, 42))) >> 24, i))
    kmers.sort()
    out = []
    for b in range(64):
        j = next((j for j, (h, _) in enumerate(kmers) if h >= (b << 34) - (1 << 39)), 0)
        one, two = sorted([kmers[j], kmers[(j + 1) % len(kmers)]], key=lambda x: x[1])
        out.append(f"{hash_long(two[0], hash_long(one[0], 42)) & 0xFFFF:04x}")
    return "".join(out)


def alike(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64


def expected(pairs):
    key = lambda p: (p[0] is None, -(p[0] or 0), signed(xxhash.xxh64_intdigest(p[1].encode(), 42)))
    order = sorted({(i, t or "") for i, t in pairs}, key=key)
    out = {}
    for at, (i, t) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + following[:k]
        out[i, t] = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute(t), brute(e), alike(brute(t), brute(e)), alike(brute(t), brute(following)))
    return sorted((out[i, t or ""] for i, t in pairs), key=str)


def test_equals_brute_force(docs, edge_pairs):
    got = es.edit_likeness(docs(edge_pairs, more=("x", "fingerprint", "_rank_at")))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(edge_pairs)


def test_one_text_and_none(docs):
    assert [tuple(r) for r in es.edit_likeness(docs([(1, "a b c d")])).collect()] == expected([(1, "a b c d")])
    assert es.edit_likeness(docs([(1, "a")]).where("doc_id = 2")).collect() == []


def test_signature_is_sensitive_to_order(docs):
    words = [f"w{i}" for i in range(400)]
    base, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    near = " ".join(words[:200] + ["new"] + words[200:])
    got = {r.doc_id: r.fingerprint.hex() for r in es.fingerprints(docs([(1, base), (2, swapped), (3, near)])).collect()}
    assert alike(got[1], got[3]) > 0.9 > 0.75 > alike(got[1], got[2])


def test_no_python_in_the_plan(docs, edge_pairs):
    plan = es.edited(docs(edge_pairs)).withColumnRenamed("n", "m").transform(es.fingerprints)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop", "Window"))

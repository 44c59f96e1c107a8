"""All spans of the personal data operator, those of the bootstrap too, against a version in plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import common, pii

KEY = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{32,}")
CARD = r"[0-9]+(?:[\x20-][0-9]+)*"
KINDS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", CARD, r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return 12 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def wanted(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    return [True, kind == 1 and all(int(p) <= 255 for p in s.split(".")), luhn(digits), 9 <= len(digits) <= 15][kind]


def context(gap):
    end = len(gap)
    while end and not gap[end - 1].isalpha():
        end -= 1
    start = end
    while start and gap[start - 1].isalpha():
        start -= 1
    return f"{gap[start:end].lower()}|{re.sub('[ \t\n\x0b\f\r]', '', gap[end:])}" if start < end else None


def matches(text, pattern, ok):
    at = 0
    for m in re.finditer(pattern, text):
        if ok is None or ok(m[0]):
            yield m.start(), m.end(), m[0], context(text[at : m.start()])
            at = m.end()
        elif ok is not token:  # a match that is not wanted still ends what the next one looks back over
            at = m.end()


def token(s):
    return len(s) >= 8 and any(c.isdigit() for c in s)


def shape(s):
    for name, p in (("digits", "[0-9]+"), ("hex", "[0-9a-f]+"), ("upper", "[A-Z0-9]+"), ("mixed", "[A-Za-z0-9_-]+")):
        if re.fullmatch(p, s):
            return name
    return "other"


def trusted(edges, rounds=2, least=0.8, support=3):
    sure, known = dict(edges), 0
    while True:
        trust = {e: float(s) for e, s in sure.items()}
        for i in range(rounds):
            total, n, sures = defaultdict(float), defaultdict(int), defaultdict(int)
            for e, v in trust.items():
                for level in (0, 1):
                    total[level, e[level]] += v
                    n[level, e[level]] += 1
                    sures[level, e[level]] += sure[e]
            score = {k: total[k] / (n[k] + 1) for k in n}
            if i < rounds - 1:
                far = defaultdict(float)
                for e in trust:
                    best = [score[level, e[level]] for level in (0, 1) if sures[level, e[level]]]
                    if best:
                        far[e[2]] += math.log1p(-min(max(best), 0.999))
                trust = {e: 1.0 if sure[e] else 1 - math.exp(far[e[2]]) if e[2] in far else 0.0 for e in trust}
        good = {k[1] for k in score if score[k] >= least and sures[k] >= support}
        if len(good) == known:
            return good
        known = len(good)
        accepted = {e[2] for e in edges if e[0] in good or e[1] in good}
        sure = {e: s or e[2] in accepted for e, s in edges.items()}


def plain(texts):
    rows, edges = [], {}
    for t in texts:
        base = sorted((s, k, e, x, c) for k, p in enumerate(KINDS) for s, e, x, c in matches(t, p, lambda x, k=k: wanted(k, x)))
        maybe = [(s, 4, e, x, c) for s, e, x, c in matches(t, r"[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*", token) if not any(b[0] < e and s < b[2] for b in base)]
        rows.append((base, maybe))
        for _, k, _, x, c in base + maybe:
            if c is not None:
                edge = (c, f"{c}|{shape(x)}", x)
                edges[edge] = edges.get(edge, False) or k < 4 or bool(KEY.fullmatch(x))
    good = trusted(edges)
    for base, maybe in rows:
        more = [r for r in maybe if KEY.fullmatch(r[3]) or (r[4] is not None and (r[4] in good or f"{r[4]}|{shape(r[3])}" in good))]
        yield ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _, _ in sorted(base)), ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _, _ in sorted(base + more))


def crafted():
    rng = random.Random(8)
    some = lambda abc, n: "".join(rng.choices(abc, k=n))
    out = []
    for i in range(400):
        kind = rng.choice(["hex", "card", "mixed", "dash", "short", "words"])
        x = {"hex": hashlib.md5(str(i).encode()).hexdigest(), "card": "4111111111111111", "mixed": some("abcXYZ0123", 14), "dash": f"{some('ab1', 5)}-{some('cd2', 5)}_{some('EF3', 4)}", "short": some("abc12", 6), "words": "plain words"}[kind]
        mark = rng.choice(["token = ", "api key: ", "Schlüssel »", "room ", "ÜBER-id #", "7 ", "", "seen at 1.2.3.4, then "])
        out.append(f"{some('abc ', rng.randint(0, 12))} {mark}{x} {rng.choice(['end', 'token = x1', ', ' + some('ab12', 9), ''])}")
    return out


@pytest.mark.parametrize("which", ["crafted", "documents"])
def test_all_spans(spark, which):
    if which == "crafted":
        texts = crafted()
    else:
        texts = [r.text or "" for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    added = 0
    for t, (base, spans), r in zip(texts, plain(texts), got, strict=True):
        assert (r.base_sha256, r.spans) == (hashlib.sha256(base.encode()).hexdigest(), spans), t[:300]
        added += r.n_id
    assert added  # else nothing but base spans was compared


def test_spans_of_many_matches_are_gathered_in_folds(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a@b.cd", "1.2.3.4", "ab12cd34ef", "plain", "+49 (30) 123 4567"]) for _ in range(n)) for n in (0, 1, 6, 7, 8, 70)]
    monkeypatch.setattr(pii, "_FOLD", 3)
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for (base, spans), r in zip(plain(texts), got, strict=True):
        assert (r.base_sha256, r.spans) == (hashlib.sha256(base.encode()).hexdigest(), spans)

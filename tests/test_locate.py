"""Quotations found by the index of words, against a plain search of whole documents."""

import random
import re

from pairsight.operators.locate import locate
from pairsight.sources.documents import lines

SLACK = 2


def pattern(q):
    return re.compile(r"\s+".join(re.escape(p) for p in q.split()))


def plain(pages, quote, hint, only=None):
    """page, line, start, text, rest_start, rest."""
    if not (quote or "").strip():
        return None
    every = [(p, n, ls) for p, ls in enumerate(pages, 1) if only in (None, p) for n in range(1, len(ls) + 1)]
    every.sort(key=lambda x: (x[1] != (hint or 0), x[0], x[1]))
    for p, n, ls in every:
        if m := pattern(quote).search(ls[n - 1]):
            return p, n, m.start(), m.group(), None, None
    every = [(p, n, ls) for p, ls in enumerate(pages, 1) if only in (None, p) for n in range(1, len(ls))]
    for m in re.finditer(r"(?<=[0-9A-Za-z])-(?=[0-9A-Za-z])", quote.strip()):
        head, tail = pattern(quote.strip()[: m.end()]), pattern(quote.strip()[m.end() :])
        for p, n, ls in every:
            h = head.search(ls[n - 1])
            if h and not ls[n - 1][h.end() : h.end() + 1].strip():
                for x in tail.finditer(ls[n]):
                    if abs(x.start() - h.start()) <= SLACK:
                        return p, n, h.start(), h.group(), x.start(), x.group()
    words = quote.split()
    for k in range(len(words) - 1, 1, -1) if len(words) >= 4 else ():
        head, tail = pattern(" ".join(words[:k])), pattern(" ".join(words[k:]))
        for p, n, ls in every:
            h, x = head.search(ls[n - 1]), tail.search(ls[n])
            if h and x:
                return p, n, h.start(), h.group(), x.start(), x.group()
    return None


def test_quotations_are_found_as_by_a_plain_search(spark):
    r = random.Random(8)
    word = lambda: r.choice(["of", "the", "alpha", "beta", "gamma", "a", "b-", "ABC-", "4711", "é😀", "x.y", "(z)", "alphabet", "beta-", "10993-", "5"])
    docs, quotes = {}, []
    for d in range(24):
        pages = [[" " * r.choice([0, 0, 1, 5]) + r.choice([" ", "  ", "\t"]).join(word() for _ in range(r.choice([0, 1, 2, 5, 9]))) + r.choice(["", "  "]) for _ in range(r.choice([1, 4, 12]))] for _ in range(r.choice([1, 2]))]
        docs[str(d)] = pages
        flat = [(p, n, x) for p, ls in enumerate(pages) for n, x in enumerate(ls)]
        for i in range(60):
            p, n, x = r.choice(flat)
            ls = pages[p]
            if i % 3 == 0 and n + 1 < len(ls):
                both = x.rstrip() + ("" if x.rstrip().endswith("-") and r.random() < 0.7 else " ") + ls[n + 1].strip()
                cut = sorted(r.randint(0, len(both)) for _ in range(2))
                q = both[cut[0] : cut[1]]
            elif i % 10 == 1:
                q = " ".join(word() for _ in range(r.randint(1, 5)))
            else:
                cut = sorted(r.randint(0, len(x)) for _ in range(2))
                q = x[cut[0] : cut[1]]
            quotes.append((str(d), "report", str(len(quotes)), q if i != 7 else None, r.choice([None, 0, n + 1, n + 2]), r.choice([None, None, 1, 2])))
    table = lines(spark.createDataFrame([(d, "report", "", "\f".join("\n".join(ls) for ls in pages)) for d, pages in docs.items()], "pair_id string, doc_key string, name string, text string"))
    q = spark.createDataFrame(quotes, "pair_id string, doc_key string, quote_id string, quote string, hint int, only_page int")
    got = {x.quote_id: (x.page, x.line, x.start, x.text, x.rest_start, x.rest) for x in locate(q, table).collect()}
    assert len(got) == len(quotes)
    ways = [0, 0, 0]
    for d, _, i, quote, hint, only in quotes:
        wanted = plain(docs[d], quote, hint, only)
        assert got[i] == (wanted or (None,) * 6), (docs[d], quote, hint, only)
        ways[0 if wanted is None else 1 if wanted[4] is None else 2] += 1
    assert min(ways) > 20, ways


def test_no_quotation_meets_a_whole_document(spark):
    table = lines(spark.createDataFrame([("p", "report", "", "x")], "pair_id string, doc_key string, name string, text string"))
    q = spark.createDataFrame([("p", "report", "1", "x", 1)], "pair_id string, doc_key string, quote_id string, quote string, hint int")
    plan = locate(q, table)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join (?:Inner|LeftOuter), (.*)", plan)
    assert joins and all(j.count(" = ") + j.count("<=>") >= 3 for j in joins), joins

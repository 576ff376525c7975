import re

import corpus_pipeline
from fixtures_llm import CLASH, components, contamination, dedup_lines, docs, measures, texts
from skein.llm import bpe, common, line_dedup, quality

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_kept(data):
    """Rows (doc_id, text, lang, source, ...) that the rules keep, by sorting
    the values of every group."""
    def low(v):
        drop = max(v.bit_length() - quality.SUB_BITS - 1, 0)
        return v >> drop << drop
    found = []
    for d in data:
        n, chars, sym, dup, rep, lines = measures(d[1])
        found.append((d, n < 10 or 100 * rep > 20 * n, {
            "symbols": 10000 * sym // max(n, 1), "length": 1000 * chars // max(n, 1), "dups": 10000 * dup // max(lines, 1)}))

    def fence(signal, keys):
        v = sorted(low(s[signal]) for d, failed, s in found if not failed and all(d[i] == k for i, k in keys.items()))
        if not v:
            return 0, None
        at = [next(x for i, x in enumerate(v) if 10 * (i + 1) >= k * len(v)) for k in (1, 5, 9)]
        # of equal values the last decides how many lie at or below
        at = [next(x for x in v if 10 * sum(y <= x for y in v) >= k * len(v)) for k in (1, 5, 9)]
        width = max(min(at[1] - at[0], at[2] - at[1]) * quality.FENCE, quality.SLACK[signal])
        return len(v), (at[1] - width if signal == "length" else -1, at[1] + width)
    memo, kept = {}, []
    for d, failed, s in found:
        ok = not failed
        for signal, v in s.items():
            for keys in ({2: d[2], 3: d[3]}, {2: d[2]}, {}):
                k = (signal, tuple(sorted(keys.items())))
                if k not in memo:
                    memo[k] = fence(signal, keys)
                if memo[k][0] >= quality.MIN_GROUP or not keys:
                    break
            if memo[k][1]:
                ok &= memo[k][1][0] <= v <= memo[k][1][1]
        if ok:
            kept.append(d)
    return kept


def by_stage(spark, data, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        data = common.store(stage(spark, data, sf), "test-stage")
        out.append(data)
    return out


def test_stages_brute(spark):
    """Each stage on its own input; what it keeps against a brute-force version."""
    source = common.table(spark, SF, "documents")
    out = by_stage(spark, source, SF)
    assert all(d.columns == source.columns for d in out[:-1])
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
    rules, lines, near, clean, ids = map(rows, out)
    assert rules == quality_kept(rows(source)) and 0 < len(rules) < 200
    cut = dedup_lines([(r[0], r[1], r[3]) for r in rules], line_dedup.MIN_SITES, line_dedup.MIN_WORDS)
    want = [(r[0], t) for r, (t, gone) in zip(rules, cut) if not gone or re.search(r"[^\x20\x09-\x0D]", t)]
    assert [(r[0], r[1]) for r in lines] == want
    comp, sizes = components([r[1] for r in lines], 5, 80)
    assert [r[0] for r in near] == [r[0] for i, r in enumerate(lines) if comp[i] == i]
    bench = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert [r[0] for r in clean] == [r[0] for r in near if not contamination(r[1], bench)[1]]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_path())
    for r, e in zip(clean, t.encode_batch([r[1] for r in clean], add_special_tokens=False)):
        got = next(x for x in ids if x[0] == r[0])
        assert list(got[1]) == e.ids and got[2] == len(e.ids)
        assert got[3] == len(t.decode(e.ids, skip_special_tokens=False))
    assert len(ids) == len(clean)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns of clashing
    names, an empty table."""
    data = docs(spark, clash=True)
    *kept, ids = by_stage(spark, data, SF)
    assert all(d.columns == COLS + CLASH for d in kept)
    rows = [tuple(r) for r in data.select(*COLS).collect()]
    first = [tuple(r) for r in kept[0].select(*COLS).collect()]
    assert sorted(first, key=repr) == sorted(quality_kept(rows), key=repr)
    held = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert held[0] >= held[1] >= held[2] >= held[3] == {r["doc_id"] for r in ids.collect()}
    assert {0, 4, 5} <= held[3]                         # clean texts that are like no other
    assert kept[2].groupBy("doc_id").count().where("count > 1 and doc_id is not null").count() == 0
    copies = [i for i, x in enumerate(texts()) if x == texts()[0]]
    assert len(held[2] & set(copies)) == 1
    for part in by_stage(spark, docs(spark, clash=True, data=[]), SF):
        assert part.count() == 0

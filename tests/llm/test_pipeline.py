import numpy as np
import public_tokenizers
from test_near import exact_survivors

import corpus_pipeline
from tabulon.llm import decontamination, pii, quality_rules
from tabulon.llm.common import stored, table
from tabulon.llm.encoding import Encoder

AT = "/root/testdata/sf0.001"


def by_stage(spark, docs, folder):
    """The rows after each stage; all but the last have the columns of documents."""
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    return out


def holds_an_item(text, items):
    """By an alignment with every item, no seeds; test_matching compares the alignment with a plain one."""
    words = decontamination.WORD.findall((text or "").lower())
    for item in items:
        seen = {w: n for n, w in enumerate(dict.fromkeys(item + words))}
        if item and words and set(item) & set(words):
            score = decontamination.local_alignment(np.array([seen[w] for w in item]), np.array([seen[w] for w in words]))[0]
            if score >= max(decontamination.THRESHOLD * len(item), min(len(item), decontamination.LEAST_WORDS)):
                return True
    return False


def plain_packing(texts):
    """The ids of each text with its end, as the pieces must give them back."""
    return [np.frombuffer(x, "<u4").tolist() + [0] for x in Encoder(public_tokenizers.path("byte_bpe_50k.json")).whole(texts)]


def check(spark, docs, stages, bench):
    quality, near, clean, private, packed = stages
    rows = docs.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    keep = {r.doc_id for r in quality_rules.ledger(docs).filter(quality_rules.passes("clean", 1)).collect()}
    assert sorted(map(key, quality)) == sorted(key(r) for r in rows if r.doc_id in keep)
    ordered = sorted(quality, key=key)
    lower = [(r.text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for r in ordered]
    assert sorted(map(key, near)) == [key(ordered[i]) for i in exact_survivors(lower)] if ordered else not near
    items = [decontamination.WORD.findall((t or "").lower()) for t in bench]
    assert sorted(map(key, clean)) == sorted(key(r) for r in near if not holds_an_item(r.text, items))
    field = pii.fit(pii.labelled_table(spark))
    want = [r.text and pii.redact(r.text, pii.find([r.text], field)[0]) for r in sorted(clean, key=key)]
    got = sorted(private, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.text for r in got] == want and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    ids = {r.doc_id: x for r, x in zip(got, plain_packing([r.text or "" for r in got]))}
    held: dict = {}
    for r in packed:
        held.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: sum((x for _, x in sorted(v)), []) for k, v in held.items()} == ids


def test_stages_as_plain_versions(spark):
    docs = table(spark, AT, "documents")
    bench = [r.text for r in table(spark, AT, "benchmark").collect()]
    stages = by_stage(spark, docs, AT)
    check(spark, docs, stages, bench)
    assert 0 < len(stages[3]) < len(stages[0])
    assert {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, AT).collect()} == {(r.doc_id, r.start, r.length) for r in stages[4]}


def test_odd_tables(spark, folder, odd, none):
    stages = by_stage(spark, odd, folder)
    words = lambda r: len((r.text or "").split())
    assert all(words(r) >= 50 for r in stages[0])  # null, empty and short texts are rejected
    assert {r.doc_id for r in stages[0]} >= {8} and all(r.row is not None for r in stages[0] if r.doc_id == 8)
    assert len({r.doc_id for r in stages[1]}) == len(stages[1])
    assert sum(r.length for r in stages[4]) == sum(map(len, plain_packing([r.text for r in stages[3]])))
    assert by_stage(spark, none, folder) == [[], [], [], [], []]


def test_odd_rows_at_each_stage(spark, folder, odd, odd_rows):
    """Stages by themselves, as null, empty and repeated rows never get past the rules."""
    from collections import Counter

    functions = dict(corpus_pipeline.STAGES)
    near = functions["simhash_near_dedup"](spark, odd, folder).collect()
    # texts without words are one; no others of these texts are near each other
    assert len(near) == len({(t or "").strip(" \n\t\x0b\x0c") for _, t, *_ in odd_rows})
    clean = functions["decontamination"](spark, odd, folder).collect()
    bench = ["same text here same text", None, "", "one"]
    items = [decontamination.WORD.findall((t or "").lower()) for t in bench]
    assert Counter(r.text for r in clean) == Counter(t for _, t, *_ in odd_rows if not holds_an_item(t and t[:3000], items))
    private = functions["personal_data"](spark, odd, folder).collect()
    assert len(private) == len(odd_rows) and sum(r.text is None for r in private) == 1
    packed = functions["packing"](spark, odd, folder).collect()
    assert sum(r.length for r in packed) == sum(map(len, plain_packing([t or "" for _, t, *_ in odd_rows])))

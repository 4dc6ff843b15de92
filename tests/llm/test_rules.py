import re
from collections import Counter

from tabulon.llm import quality_rules as q

TEXTS = ["a b c a b c a b c d", "x\ny\nx\n\n \nx", "*** $$$ A!! B!!", "a b c x a b d a b c", "", "one two", "é ñ ç", "a a a a", " ".join(f"word{i}" for i in range(60))]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in q.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(TEXTS[r.doc_id])


def test_policies_and_ablation(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    book = q.ledger(df)
    assert [r.doc_id for r in q.accepted(df).collect()] == [8]
    rows = {r.rule: r for r in q.ablation(book, "clean", 1).collect()}
    bits = [r.fail_bits for r in book.collect()]
    for name, bit in q.BIT.items():
        assert rows[name].n_failing == sum(bool(b & bit) for b in bits)
        assert rows[name].n_only == sum(b == bit for b in bits)
        assert rows[name].n_kept_without == sum(not b & ~bit for b in bits)


def test_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for frame in (q.ledger(df), q.accepted(df), q.ablation(q.ledger(df), "base", 1)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)

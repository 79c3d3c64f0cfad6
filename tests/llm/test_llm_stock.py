"""Closing sentences: copies of one item and long sentences are no stock instructions."""

from corvane.llm import leakage


def test_copies_and_long_closing_sentences_are_found(spark):
    long = "the " + " ".join(f"word{k}" for k in range(30)) + "."
    copied = " ".join(f"term{k}" for k in range(25)) + "."
    items = [(k, f"Case number {'abc'[k]} differs. {long}", None) for k in range(3)] + [(k, copied, None) for k in (7, 8, 9)]
    items += [(20 + k, f"{' '.join(f'item{k}x{n}' for n in range(25))}. Answer with one letter only.", None) for k in range(3)]
    docs = [(1, f"before {long} after"), (2, f"before {copied} after"), (3, "Answer with one letter only. " * 9)]
    df = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string"))
    assert {tuple(r) for r in df.collect()} == {(1, 0), (1, 1), (1, 2), (2, 7), (2, 8), (2, 9)}


def test_answers_that_items_share_are_found(spark):
    answer = " ".join(f"part{k}" for k in range(30)) + "."
    short = "Say why the cache was stale and which of the two writers had been late in the run that failed"
    items = [(k, f"Question {'abcdef'[k]} of its own?", answer) for k in range(3)] + [(3 + k, f"Asked {'xyz'[k]} once?", f"{'uvw'[k]} first. {short}.") for k in range(3)]
    docs = [(1, f"so {answer} then"), (2, f"so u first {short} then")]
    df = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string"))
    assert {tuple(r) for r in df.collect()} == {(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5)}

from sluice.plans import wordcount

LINES = [(0, "The cat, the CAT!"), (1, "a_b  --  über"), (2, ""), (3, None), (4, "cat")]


def lines(spark):
    return spark.createDataFrame(LINES, "n bigint, text string")


def test_words(spark, collected):
    assert collected(wordcount.wordcount(lines(spark))) == [("a_b", 1), ("ber", 1), ("cat", 3), ("the", 2)]


def test_two_inputs(spark, collected):
    got = dict(collected(wordcount.wordcount_two_inputs(lines(spark), lines(spark))))
    assert got == {"a_b": 2, "ber": 2, "cat": 6, "the": 4}


def test_running(spark, collected):
    for width, span in ((1, 1), (1, 2), (1, 100), (2, 1), (100, 1)):
        got = collected(wordcount.wordcount_running(lines(spark), "n", lines_per_slice=width, slices_per_span=span))
        assert got == [(0, 0, "the", 1), (0, 1, "cat", 1), (0, 2, "the", 2), (0, 3, "cat", 2), (1, 0, "a_b", 1),
                       (1, 1, "ber", 1), (4, 0, "cat", 3)]


def test_running_counts_of_scattered_lines(spark, collected):
    """Any order of the rows, positions on both sides of zero, one of them missing."""
    texts = [None if i % 11 == 0 else " ".join(f"w{(i * k) % 7}" for k in range(i % 9)) for i in range(60)]
    stored = [(None if i == 59 else (i * 37) % 59 - 30, text) for i, text in enumerate(texts)]
    so_far, want = {}, []
    for position, text in sorted(stored, key=lambda line: (line[0] is not None, line[0])):
        for place, word in enumerate((text or "").split()):
            so_far[word] = so_far.get(word, 0) + 1
            want.append((position, place, word, so_far[word]))
    lines = spark.createDataFrame(stored, "n int, text string").repartition(5)
    for width, span in ((1, 2), (4, 3), (100, 1)):
        counted = wordcount.wordcount_running(lines, "n", lines_per_slice=width, slices_per_span=span)
        assert counted.schema["n"].dataType == lines.schema["n"].dataType
        assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, want))

"""Language by held-out accuracy; decontamination against full edit distance."""

import random

import numpy as np
import pytest

from seqloom.llm import decontaminate as dc
from seqloom.llm import language

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = language.op10_zstd_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 40").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert got.count() == 1000


def test_language_of_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !? \n", "en"), (None, "the cat and the dog " * 9, "en"), (5, "le chat et la souris " * 9, "fr"), (5, "le chat " * 400_000, None), (6, "der hund und die katze " * 9, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", language.F.lit(1)).withColumn("h", language.F.lit(1))
    raw = language.dictionaries(df)
    assert [*raw] == ["en", "de", "fr"]
    got = language.identify(df, raw).collect()
    assert sorted(r["lang_pred"] for r in got) == ["de", "en", "fr", "fr", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(df, {}).where("lang_pred = 'und'").count() == 7
    assert language.identify(df.limit(0), raw).count() == 0 and language.dictionaries(df.limit(0)) == {}


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(at, "x"), lambda: chars.insert(at, "y"), lambda: chars.pop(at)])()
    return "".join(chars)


@pytest.mark.parametrize("seed", range(4))
def test_nothing_within_the_budget_is_missed(seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(8, 40))) for k in range(12)]
    index = dc.Items(items, 12, 0.05)
    for _ in range(40):
        k, item = rng.choice(items)
        text = dc.normal(words(rng, rng.randint(0, 30)) + " " + edited(rng, item, rng.randint(0, 16)) + " " + words(rng, rng.randint(0, 30)))
        got = {i: e for i, e, _, _ in index.matches(text)}
        for pos, (i, t) in enumerate(items):
            d = distance_in(dc.normal(t), text)
            assert got.get(i) == (d if d <= index.edits[index.ids.index(i)] else None), (pos, d)


def test_places_and_short_items():
    index = dc.Items([(1, "The quick brown fox jumps over the lazy dog"), (2, "tiny"), (3, ""), (4, None)], 12, 0.05)
    text = dc.normal("So  THE quick brown\nfox jumps over the lazy dog, tiny one tinyish")
    got = {i: (e, s, n) for i, e, s, n in index.matches(text)}
    assert got[1] == (0, 3, 43) and text[3:46] == "the quick brown fox jumps over the lazy dog"
    assert got[2][0] == 0 and set(got) == {1, 2}
    assert index.matches("") == []


def test_alignment_keeps_to_its_band():
    rng = random.Random(11)
    for _ in range(150):
        item, text = words(rng, 4), words(rng, 6)
        text = text[: rng.randrange(len(text))] + edited(rng, item, rng.randint(0, 3)) + text
        a, b = dc.points(item), dc.points(text)
        whole = dc.align(a, b, 99, -len(item), len(text) + len(item) + 1)
        assert whole[0] == distance_in(item, text)
        near = text[whole[1] : whole[1] + whole[2]]
        assert max(distance_in(item, near), distance_in(near, item)) <= whole[0]
        first, width = whole[1] - whole[0], 2 * whole[0] + 1  # the path cannot leave these diagonals
        assert dc.align(a, b, 99, first, width)[0] == whole[0] and dc.align(a, b, whole[0] - 1, first, width) is None


def test_very_long_texts():
    item = "one two three four five six seven eight nine ten eleven"
    index = dc.Items([(1, item)], 12, 0.05)
    text = "filler words " * 200_000 + item.replace("six", "sax") + " more" * 100_000
    assert index.matches(text) == [(1, 1, 13 * 200_000, len(item))]


def test_languages_against_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    raw = language.dictionaries(docs)
    assert sorted(raw) == ["de", "en", "es", "fr"] and all(1000 < len(d) <= 65_536 for d in raw.values())
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, raw).collect()}
    for r in docs.collect():
        text = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        data, total = " ".join(text.split()).encode(), {}
        for name, d in raw.items():
            coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            total[name] = sum(len(coder.compress(data[k : k + 2048])) for k in range(0, len(data), 2048))
        assert got[r["doc_id"]] == (min([*raw], key=total.get) if data else "und")


def test_every_sampled_text_is_in_the_dictionary():
    texts = [b"a" * 10, b"b" * 1000, "é".encode() * 600, b""]
    parts = language.even_parts(texts, 213)
    assert parts[0] == texts[0] and parts[3] == b"" and len(parts[1]) == 100 and len(parts[2]) == 100
    assert len(b"\n".join(parts)) == 213
    assert language.even_parts(texts[:2], 9999) == texts[:2] and language.even_parts([], 10) == []


def test_contaminated_frames(spark):
    docs = spark.createDataFrame([(1, "x " * 50 + "one two three four five six seven eight nine ten " + "y " * 50), (None, "one two three four five six seven eight nine ten"), (3, None), (4, ""), (5, "clean text of no interest at all, none")], "doc_id long, text string").withColumn("edits", dc.F.lit(1))
    items = spark.createDataFrame([(9, "ONE two three four five six seven eight nine ten"), (8, None), (7, "never seen anywhere in any of the documents")], "item_id long, text string")
    for bytes_ in (16_000_000, 30):
        got = sorted(((r["doc_id"] or 0), r["item_id"], r["edits"]) for r in dc.contaminated(docs, items, slice_bytes=bytes_).collect())
        assert got == [(0, 9, 0), (1, 9, 0)]
        kept = dc.uncontaminated(docs, items, slice_bytes=bytes_)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0


def test_hashes_of_all_lengths():
    chars = np.arange(1, 60, dtype=np.uint32)
    for q in range(1, 20):
        h = dc.gram_hashes(chars, q)
        assert len(h) == 60 - q and len(np.unique(h)) == len(h)
        assert (dc.gram_hashes(chars[5:], q) == h[5:]).all()


def test_long_repetitive_texts_keep_memory_bounded():
    """5 MB of one character against items of that character, one of them with a foreign character in it."""
    import resource

    item, odd = "a" * 394, "a" * 200 + "b" + "a" * 60
    index = dc.Items([(1, item), (2, odd)], 12, 0.05)
    assert index.matches("a" * 30_000 + "b" + "a" * 30_000) == [(1, 0, 0, 394), (2, 0, 29_800, 261)]
    index = dc.Items([(1, item)], 12, 0.05)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert index.matches("a" * 5_000_000) == [(1, 0, 0, 394)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_pieces_find_what_one_piece_finds(monkeypatch):
    """Small pieces, pairs and widths against large ones and against full edit distance."""
    rng = random.Random(8)
    items = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(30, 120)))) for k in range(12)] + [(99, "ab" * 40), (98, "-" * 50)]
    texts = []
    for _ in range(25):
        parts = [rng.choice(["ab" * 60, "-" * 200, rng.choice(items)[1], "".join(rng.choice("ab ") for _ in range(50))]) for _ in range(rng.randint(1, 5))]
        texts.append(dc.normal(" ".join(parts)))
    index = dc.Items(items, 12, 0.05)
    want = [sorted((i, e) for i, e, _, _ in index.matches(t)) for t in texts]
    for name, value in (("PLACES", 37), ("PAIRS", 50), ("WIDE", 16)):
        monkeypatch.setattr(dc, name, value)
    assert [sorted((i, e) for i, e, _, _ in index.matches(t)) for t in texts] == want
    for k, t in enumerate(texts):
        for i, e, start, length in index.matches(t):
            own = dc.normal(dict(items)[i])
            assert edit_distance(own, t[start : start + length]) == e
        assert all((i, 0) in want[k] for i, text in items if len(dc.normal(text)) >= 12 and dc.normal(text) in t)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_equal_items_and_slices(spark):
    """Equal items are one text: thousands of them make no large slice, and each of them gives a row."""
    text = "an item that many rows of the benchmark hold word for word " * 3
    items = spark.createDataFrame([(k, text) for k in range(300)] + [(1000 + k, f"{k} other items, told apart by their number {k * k} alone") for k in range(40)] + [(5000, None), (None, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text), (2, "nothing"), (3, "so 7 other items, told apart by their number 49 alone it is"), (4, None)], "doc_id long, text string")
    want = sorted([(1, k, 0) for k in range(300)] + [(1, -1, 0), (3, 1007, 0)])
    for size in (16_000_000, 1000):
        got = dc.contaminated(docs, items, slice_bytes=size).collect()
        assert sorted((r["doc_id"], -1 if r["item_id"] is None else r["item_id"], r["edits"]) for r in got if r["edits"] == 0) == want
        assert sorted(r["doc_id"] for r in dc.uncontaminated(docs, items, slice_bytes=size).collect()) == [2, 4]
    sizes = [[len(t) for _, t in part] for _, load in dc.slices(items, 1000)[1] for part in load()]
    assert len(sizes) > 2 and max(map(sum, sizes)) < 2000 and sum(map(len, sizes)) == 41


def test_the_number_of_languages_is_bounded(spark):
    rows = [(f"text of {k} " * 4, f"l{k % 7:02d}" if k < 90 else f"x{k}") for k in range(120)]
    found = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"), most_languages=5)
    assert [*found] == ["l00", "l01", "l02", "l03", "l04"] and all(found.values())

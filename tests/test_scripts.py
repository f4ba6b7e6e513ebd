import random
from pathlib import PurePath

from pyspark.sql import functions as F

from glossweave.constants import SCRIPTS
from glossweave.functions import scripts as S

NAMES = [
    "alpha", "ice_cream", "a b", "Bêta", "слово", "λόγος", "漢字", "かな", "漢字かなカナ", "1st", "×x", "C#",
    "100%", "e.g.", "St. John", "x.html", ".hid", "_under", "a.b", "...", "a..b", "한국어", "كلمة", "שלום",
    "हिन्दी", "ไทย", "aб", "бa", "12", "", "٣", "ªº", "i.tar.gz", "ab漢字",
]


def dominant(name):
    counts = {script: 0 for script, _ in SCRIPTS}
    for char in PurePath(name).stem if name else "":
        if char.isalnum():
            for script, ranges in SCRIPTS:
                if any(lo <= ord(char) <= hi for lo, hi in ranges):
                    counts[script] += 1
                    break
    best = max(counts, key=counts.get)
    return best if counts[best] else "unknown"


def kept(name, wanted):
    ranges = [r for script, rs in SCRIPTS if script in wanted for r in rs]
    first = bool(name) and any(lo <= ord(name[0]) <= hi for lo, hi in ranges)
    return first or dominant(name) in wanted


def random_names():
    rng = random.Random(3)
    pool = "".join(NAMES) + "._ é"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(2000)]


def test_names_and_scripts(spark):
    names = [n for n in NAMES + random_names() if "/" not in n]
    wanted = ["cyrillic", "japanese"]
    w = F.col("w")
    rows = spark.createDataFrame([(n,) for n in names], "w string").select(
        w,
        S.is_page_name(w).alias("page"),
        S.stem(w).alias("stem"),
        S.dominant_script(w).alias("script"),
        S.in_scripts(w, wanted).alias("kept"),
        S.in_scripts(w, ["all", "thai"]).alias("all"),
        S.in_scripts(w, ["klingon"]).alias("none"),
    ).collect()
    for row in rows:
        if row.w.strip("."):
            # A name of dots only is no file name; there pathlib has its own rules.
            suffix = len(row.w) > 1 and "." in row.w[1:-1] and row.w.rfind(".") == row.w[:-1].rfind(".")
            suffix = suffix and 0 < row.w.rfind(".") < len(row.w) - 1
            assert row.page == (not suffix and not row.w.startswith(".")), row.w
            assert row.stem == (row.w[: row.w.rfind(".")] if suffix else row.w), row.w
            assert row.kept == kept(row.w, wanted), row.w
            if row.stem == PurePath(row.w).stem:
                assert row.script == dominant(row.w), row.w
        assert row["all"] and not row.none


def test_is_in_script(spark):
    rows = spark.createDataFrame([("漢",), ("a",), ("ё",)], "c string").select(
        *[S.is_in_script(F.col("c"), s).alias(s) for s in ("chinese", "japanese", "latin", "cyrillic", "nope")]
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, False, False, False), (False, False, True, False, False), (False, False, False, True, False)
    ]

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve.functions import distance, text


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *"abc"[: len(rows[0])]])
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_normalize(spark):
    """Each placeholder, alone and in quotes, and tokens that just miss its form."""
    cases = {
        "tar xf 00ffee": "tar xf <SHA>", "tar xf 00ffe": "tar xf 00ffe", "tar xf 00ffeg": "tar xf 00ffeg",
        "rm /var/tmp/a.b": "rm <PATH>", "rm ./a": "rm ./a", 'rm "/var/x"': "rm <PATH>", "rm '/var/x": "rm '/var/x",
        "wget http://h.test": "wget <URL>", "wget 'https://h.test/?q=1'": "wget <URL>", "wget ftp://h.test": "wget ftp://h.test",
        "pip v10.20.30": "pip <VER>", "pip v10.20": "pip v10.20", "pip v1.2.3b": "pip v1.2.3b",
        "\t one \t\t two ": "one two", "": "",
    }
    assert values(spark, [(a,) for a in cases], text.normalize("a")) == list(cases.values())


def test_base_trim_truncate_seconds(spark):
    firsts = {"make -j 8": "make", "make": "make", "": "", " \t top -H": "top", "　tail -f": "tail"}
    assert values(spark, [(a,) for a in firsts], text.base_command("a")) == list(firsts.values())
    assert values(spark, [(" in side\r\n",), (" \t ",)], text.trim("a")) == ["in side", ""]
    for n in (69, 70, 71, 200):
        assert values(spark, [("é" * n,)], text.truncate("a")) == ["é" * n if n <= 70 else "é" * 67 + "..."]
    assert values(spark, [("1700000001.000999",), ("1700000002",), (".5",)], text.whole_seconds("a")) == ["1700000001", "1700000002", ""]


@pytest.mark.parametrize(
    ("command", "head", "rest"),
    [
        ('mail -s "two words" bob', "mail -s", "two words bob"),
        ("printf '%s\\n'", "printf %s\\n", ""),
        ('say \\"hi\\" there', 'say "hi"', "there"),
        ('sed -e "s/\\"/x/" f', "sed -e", 's/"/x/ f'),
        ('grep "" file ""', "grep ", "file "),
        ("cat 'no end", "cat no end", ""),
        ("cat end\\", "cat end", ""),
        ("x\"y\"'z' p\\ q\tr", "xyz p q", "r"),
        ("", "", ""),
    ],
)
def test_shell_words(command, head, rest):
    words = text.shell_words(command)
    assert (" ".join(words[:2]), " ".join(words[2:])) == (head, rest)


@given(st.text(alphabet="ab'\"\\ \t", max_size=12))
def test_shell_words_never_fail(command):
    assert all(isinstance(w, str) for w in text.shell_words(command))


def plain_damerau(a, b):
    return duckdb.execute("select damerau_levenshtein(?, ?)", [a, b]).fetchone()[0]


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
def test_damerau_equals_another(a, b):
    assert distance.damerau(a, b) == plain_damerau(a, b)


@given(st.text(alphabet="aé中", max_size=5), st.text(alphabet="aé中", max_size=5))
def test_damerau_is_a_distance_of_characters(a, b):
    d = distance.damerau(a, b)
    assert d == distance.damerau(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def near_words():
    """All words of up to four letters of two, and a longer one with its edits."""
    import itertools

    short = ["".join(w) for n in range(5) for w in itertools.product("xy", repeat=n)]
    word = "configure"
    edits = {word[:i] + word[i + 1 :] for i in range(9)} | {word[:i] + "z" + word[i + k :] for i in range(10) for k in (0, 1)}
    edits |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(8)}
    return [(a, b) for a in short for b in short] + [(word, e) for e in edits] + [(e, word) for e in edits]


def test_within_one_and_its_keys(spark):
    """Exactly the words at distance 1 are within one, and all of these share a key."""
    pairs = near_words()
    within = values(spark, pairs, distance.within_one("a", "b"))
    met = values(spark, pairs, F.arrays_overlap(distance.halves("a"), distance.halves("b")))
    for (a, b), near, shared in zip(pairs, within, met, strict=True):
        assert near == (distance.damerau(a, b) == 1)
        assert shared or not near
    assert values(spark, [("q" * 100_000,)], F.size(distance.halves("a"))) == [6]


def test_radius(spark):
    """The least whole number of at least (1 - t) / t times the length, by its limits."""
    for t in (0.9, 0.75, 0.6, 0.5):
        for n in (1, 3, 7, 24):
            got = values(spark, [("x" * n,)], distance.search_radius(t, F.length("a")))[0]
            assert got - 1 < (1 - t) / t * n + 1e-9 and got >= (1 - t) / t * n - 1e-9
    assert values(spark, [("x",)], distance.search_radius(1.0, F.length("a"))) == [0]
    assert values(spark, [("",)], distance.search_radius(0.75, F.length("a"))) == [0]


SIMILAR = [
    ("docker strat web", "docker start web", True),  # a swap in the head
    ("docker start web", "docker start web", False),  # nothing differs
    ("docker start web1", "docker start web2", False),  # the rest differs, the head does not
    ("docker strat web1", "docker start web2", False),  # both differ, the whole is too short to be 0.95 alike
    ("docker strat --with-a-very-long-option-nmae", "docker start --with-a-very-long-option-name", True),  # both, 0.95 alike
    ("dokcer exec /srv/a", "docker exec /srv/b", True),  # paths are one placeholder
    ("npm run", "yarn up", False),
]


def test_similar_and_its_bounds(spark):
    from logsieve.operators.strategies import prepared

    rows = [(i, a, b) for i, (a, b, _) in enumerate(SIMILAR)]
    left = prepared(spark.createDataFrame([(i, a) for i, a, _ in rows], "i int, command string"))
    right = prepared(spark.createDataFrame([(i, b) for i, _, b in rows], "i int, command string"))
    names = {c: f"{c}_2" for c in right.columns if c != "i"}
    both = left.join(right.withColumnsRenamed(names), "i")
    a = {c: F.col(c) for c in ("norm", "head", "rest")}
    b = {c: F.col(f"{c}_2") for c in ("norm", "head", "rest")}
    got = {r.i for r in distance.similar(both, a, b, 0.8).select("i").collect()}
    assert got == {i for i, (_, _, want) in enumerate(SIMILAR) if want}
    assert got <= {r.i for r in both.where(distance.heads_may_match(a["head"], b["head"], 0.8)).select("i").collect()}

"""The rules, each on logs made from the rule's own terms."""

import pytest

from logsieve.operators import stats
from logsieve.plans import classify
from logsieve.settings import Settings

DAY = 24 * 3600
NOW = 1_700_000_000
ENTRIES = "history_id string, entry_id bigint, raw string, ts string, command string"
EXITS = "history_id string, line_no bigint, ts_raw string, exit_code int"


def removals(spark, runs, settings=Settings(), allow=None):
    """runs: (command, exit code, seconds before now or None for a second of its own) -> {line: reason}."""
    entries, exits = [], []
    for line, (command, code, age) in enumerate(runs):
        ts = str(line + 1) if age is None else str(NOW - age) if isinstance(age, int) else age
        entries.append(("h", line, f": {ts}:0;{command}", ts, command))
        exits.append(("h", line, ts, code))
    found = classify.removals(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(exits, EXITS), settings, allow, NOW)
    return {r.line: r.reason for r in found.collect()}


def runs(command, good=0, bad=0, age=None):
    return [(command, 0, age)] * good + [(command, 1, age)] * bad


def others(found):
    return {line: reason for line, reason in found.items() if reason != "Duplicate"}


@pytest.mark.parametrize("times", [1, 2, 5])
def test_only_the_newest_of_a_command_stays(spark, times):
    log = (runs("uptime", 1) + runs("whoami", 1)) * times
    assert removals(spark, log) == {i: "Duplicate" for i in range(2 * times - 2)}


@pytest.mark.parametrize(("good", "bad", "found"), [(2, 1, True), (1, 1, False), (3, 3, False), (4, 3, True)])
def test_prefix_needs_more_successes_than_failures(spark, good, bad, found):
    log = runs("terraform pl", bad=bad) + runs("terraform plan -out x", good=good)
    assert others(removals(spark, log)) == ({bad - 1: "Failed prefix of 'terraform plan -out x'"} if found else {})


def test_first_of_several_longer_commands_is_named(spark):
    log = runs("helm up", bad=1) + runs("helm upgrade b", 2) + runs("helm upgrade a", 2)
    assert others(removals(spark, log)) == {0: "Failed prefix of 'helm upgrade a'"}


@pytest.mark.parametrize(
    ("failed", "good"),
    [("helm lsit", "helm list"), ("psql östen", "psql östne")],
)
def test_a_typo_is_named_after_what_works(spark, failed, good):
    log = runs(failed, bad=1) + runs(good, 3)
    assert others(removals(spark, log)) == {0: f"Failed similar to '{good}'"}


@pytest.mark.parametrize("log", [
    runs("helm lsit", 1) + runs("helm list", 3),  # it works
    runs("helm lsit", bad=2) + runs("helm list", bad=1),  # neither works
    runs("ehlm lsit", bad=1) + runs("helm list", 3),  # another first word
    runs("helm zz", bad=1) + runs("helm list", 3),  # too far
])
def test_no_typo(spark, log):
    assert not any(r.startswith("Failed") for r in removals(spark, log).values())


@pytest.mark.parametrize(("least", "found"), [(0.74, True), (0.76, False), (1.0, False), (0.0, True)])
def test_threshold_is_the_heads_ratio(spark, least, found):
    """Two of eight characters differ: 0.75."""
    log = runs("sv alpha", bad=1) + runs("sv alzza", 2)
    assert (0 in removals(spark, log, Settings(similarity=least))) == found


def test_prefix_comes_before_similar(spark):
    log = runs("helm lis", bad=1) + runs("helm list", 3)
    assert others(removals(spark, log)) == {0: "Failed prefix of 'helm list'"}


@pytest.mark.parametrize(("total", "wrong", "right", "found"), [(20, 1, 0, True), (19, 1, 0, False), (25, 3, 2, True), (25, 3, 3, False), (25, 0, 2, False)])
def test_mistyped_first_word(spark, total, wrong, right, found):
    """The right word is run ``total`` times; the mistyped one fails ``wrong`` times and works, as another command, ``right`` times."""
    log = runs("rsync -a p q", total) + runs("rsnyc -v", bad=wrong) + runs("rsnyc -h", right)
    got = {r for r in removals(spark, log).values() if r.startswith("Cross-base")}
    assert got == ({"Cross-base typo of 'rsync'"} if found else set())


def test_most_used_word_is_named(spark):
    log = runs("lpr a", 21) + runs("lpq a", 30) + runs("lpd x", bad=1)
    assert removals(spark, log)[51] == "Cross-base typo of 'lpq'"


def test_totals_of_a_word_count_all_its_commands(spark):
    log = runs("gcc a", 8) + runs("gcc b", 7, 5) + runs("gc a", bad=1)
    assert removals(spark, log)[20] == "Cross-base typo of 'gcc'"


def rare(found):
    return {r for r in found.values() if r.startswith("Rare")}


@pytest.mark.parametrize("age", [0, 7 * DAY, 7 * DAY + 1, 30 * DAY, 30 * DAY + 1])
@pytest.mark.parametrize(("seldom", "often", "alike"), [(1, 4, True), (1, 3, False), (3, 10, True), (3, 9, False)])
def test_rare_is_a_third_at_any_age(spark, age, seldom, often, alike):
    """Where all runs weigh the same only their numbers decide, as long as the sum is at most the threshold."""
    log = runs("nmap scna", seldom, age=age) + runs("nmap scan", often, age=age)
    found = rare(removals(spark, log, Settings(remove_rare=True)))
    exact = sum([1.0 if age <= 7 * DAY else 0.5 if age <= 30 * DAY else 0.1] * often) > 3 * sum([1.0 if age <= 7 * DAY else 0.5 if age <= 30 * DAY else 0.1] * seldom)
    assert found == ({"Rare variant of 'nmap scan'"} if exact else set())
    assert age or exact == alike
    assert not rare(removals(spark, log))


@pytest.mark.parametrize(("threshold", "seldom", "found"), [(3.0, 3, True), (3.0, 4, False), (0.5, 1, False), (400.0, 40, True)])
def test_rare_threshold(spark, threshold, seldom, found):
    log = runs("nmap scna", seldom, age=5) + runs("nmap scan", 3 * seldom + 1, age=5)
    assert bool(rare(removals(spark, log, Settings(rare_threshold=threshold, remove_rare=True)))) == found


def test_time_that_is_no_number_weighs_nothing(spark):
    log = runs("nmap scna", 2, age="9" * 25) + runs("nmap scan", 1, age=5)
    assert rare(removals(spark, log, Settings(remove_rare=True))) == {"Rare variant of 'nmap scan'"}


def test_rare_needs_now(spark):
    with pytest.raises(ValueError):
        classify.removals(spark.createDataFrame([], ENTRIES), spark.createDataFrame([], EXITS), Settings(remove_rare=True))


def test_allowlist_spares_all_but_secrets(spark):
    log = runs("vault login", 2) + runs("export TOKEN=" + "Zx9" * 6, 1)
    assert removals(spark, log) == {0: "Duplicate", 2: "Secret pattern: Assigned secret"}
    assert removals(spark, log, allow=["^vault", "^export"]) == {2: "Secret pattern: Assigned secret"}


def test_a_secret_goes_wherever_it_stands(spark):
    log = runs("curl -u https://me:pw@h.test/", 3)
    assert set(removals(spark, log).values()) == {"Secret pattern: URL password"} and len(removals(spark, log)) == 3


def test_last_exit_in_a_second_wins(spark):
    rows = [("h", 4, "9.25", 0), ("h", 5, "9.75", 3), ("h", 6, "10", 0)]
    found = stats.exit_by_second(spark.createDataFrame(rows, EXITS)).collect()
    assert {(r.ts, r.exit_code) for r in found} == {("9", 3), ("10", 0)}


def test_keep_newest_takes_ties_and_nulls(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), ("k", 5, "c"), ("k", 5, "d"), ("k", 4, "e"), ("one", None, "f")]
    df = spark.createDataFrame(rows, "key string, at int, what string")
    gone = sorted(r.what for r in stats.keep_newest(df, ["key"], "at").collect())
    assert gone in (["a", "c", "e"], ["a", "d", "e"])

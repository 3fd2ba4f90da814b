import pytest

from sparkloom.functions import sequences as Q


def test_numerals():
    for text, n in {"两百三十五": 235, "一万零五": 10005, "十二": 12, "三点五": 3.5, "半": 0.5, "7.25": 7.25, "x": None, "": None}.items():
        assert Q.zh_number(text) == n


def test_splitting_keeps_all_words_and_bounds():
    text = "one two three. four five six.\n\nseven eight nine ten eleven. " * 9
    parts = Q.split_text(text, 12, 3)
    assert all(Q.tokens(p) <= 12 for p in parts)
    assert set(text.split()) == {w for p in parts for w in p.split()}
    assert Q.split_text("", 5, 1) == [] and Q.split_text("a" * 30, 1, 0) == ["a" * 30]
    assert [b[2] - b[1] for b in Q.blocks("xx A b.\n\nC d\n\nE", ["A b.\n\nC d", "E"])] == [4, 3, 1]


def test_windows_end_at_lines():
    text = ("x" * 90 + "\n") * 30
    got = Q.windows(text, 500, 50)
    assert got[0] == (0, 455) and all(b - a <= 500 for a, b in got) and got[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(got, got[1:]))


def test_boundaries_come_before_a_segment_and_reset():
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert Q.boundaries([a, b, a, a, a], 0.5, 2, 20) == [2]
    assert Q.boundaries([a] * 7, 0.5, 2, 3) == [3, 6]
    assert Q.boundaries([], 0.5) == []


def test_grouping_by_size_and_speaker():
    seg = [{"start": i, "end": i + 1, "text": "abcd", "speaker": s} for i, s in enumerate("AABBB")]
    assert [g["text"] for g in Q.grouped_segments(seg, [], 8)] == ["abcd abcd", "abcd abcd", "abcd"]
    assert [g["speaker"] for g in Q.grouped_segments(seg, [], 99, True)] == ["A", "B"]
    assert Q.grouped_segments(seg, [], 99)[0]["speaker"] == "B"


def test_selection():
    assert Q.mmr(["aaaa", "aaaa", "bbbb"], [0.9, 0.9, 0.5], 2) == [0, 2] or Q.mmr(["aaaa", "aaaa", "bbbb"], [0.9, 0.9, 0.5], 2) == [0, 1]
    assert sum(Q.apportioned([0.9, 0.1, 0.5], 20, 3, 12)) == 20 and Q.apportioned([1, 1], 100, 1, 3) == [3, 3]
    assert Q.rouge_l("a b c d", "a c d") == pytest.approx(6 / 7) and Q.rouge_l("", "a") == 0


def test_text_of_files():
    assert Q.visible_text("<p>a&amp;b<script>x</script> <b>c</b><style/>d</p>") == "a&b c"
    for html, text in {
        None: "", "a < b": "a < b", "x<!-- <b>no</b> -->y": "xy", "x<!-- never closed": "x", "<SCRIPT>if (a<b) '</p>'</Script >z": "z", "<style>p{}</style><script>var t='<style>'</script>ok": "ok",
        "a<script/>b<script>c</script>d</script>e": "ae", "a<br/>b&nbsp;&lt;c&gt; &#233;&eacute;": "ab <c> éé", "<!DOCTYPE html><p class='x'>one\n\n two</p></p>": "one two", "</script>after": "after", "cut <b": "cut", "<script>open": "",
    }.items():
        assert Q.visible_text(html) == text, html
    assert Q.parsed_json('```json\n{"a": 1}\n```') == '{"a": 1}' and Q.parsed_json('so {"a": [1]} end') == '{"a": [1]}' and Q.parsed_json("none") is None
    assert Q.pretty_json("{bad") == "{bad"


def test_questions():
    assert Q.temporal_hint("in the last 5 minutes") == ("seconds", -300.0, 0.0) and Q.temporal_hint("hello") is None
    assert Q.historical_cutoffs("status as of 2024-01-05?") == ["2024-01-05"]
    assert Q.historical_cutoffs("compare 2024-02-01 with 2024-01-01") == ["2024-01-01", "2024-02-01"]
    assert Q.speaker_names("What did Bob say?", ["alice"]) == ["Bob"] and Q.speaker_names("ALICE and", ["alice"]) == ["alice"]
    assert Q.supported("costs 40 euro", "It costs exactly 40 euro. Fine") and not Q.supported("costs 40 euro", "It costs 50 euro")
    assert Q.relation_supported("Ann", "lead", "Apollo", "So Ann now leads the Apollo team") and not Q.relation_supported("Ann", "lead", "Apollo", "Ann. leads Apollo")
    assert Q.regressions({"a": {"recall": 0.9, "latency": 1.0}}, {"a": {"recall": 0.5, "latency": 0.5}}) == ["a.recall"]
    assert Q.multilingual_tokens("Ｈello_World 東京都 a") == ["hello", "world", "東京", "京都"]

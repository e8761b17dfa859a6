import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftwork.errors import TemplateError
from weftwork.functions import scope, template


@pytest.mark.parametrize(("text", "expected"), [
    ("{{ STR }}!", "Hello World!"), ("{{ NUM + 1 }}", "2"), ("{{ OBJ.val }}", "1"), ("{{ ARR[0] }}{{ ARR }}", "A[A, B]"), ("{{ d['x-y'] }}", "q"),
    ("{{ d['x-y'] == 'q' }}", "true"), ("{{ '1' | int + '2' | int }}", "3"), ("{{ none | default(value='z') }}", "z"), ("{{ 7 % 4 * 2 }}", "6"),
    ("{{ not (1 < 2) or false }}", "false"), ("{{ ARR | join(sep='-') | lower }}", "a-b"), ("plain", "plain"), ("{{ 'a' ~ 1 }}", "a1"), ("{{ -3 | abs }}", "-3"),
    ("{{ 'one two' | split(pat=' ') | last | upper }}", "TWO"), ("{{ [3, 1] | sort | first }}", "1"), ("{{ 'x' | nothing_here }}", None), ("{{ missing }}", None), ("{{ }}", None),
])
def test_render(text, expected):
    values = {"STR": "Hello World", "NUM": 1, "OBJ": {"val": 1}, "ARR": ["A", "B"], "d": {"x-y": "q"}}
    if expected is None:
        with pytest.raises(TemplateError):
            template.render(text, values)
    else:
        assert template.render(text, values) == expected


@given(st.text().filter(lambda s: "{{" not in s))
def test_text_without_template_stays(text):
    assert template.render(text, {}) == text


def test_column_and_driver_agree(spark):
    texts = [
        "{{ name | upper }}: {{ n + 1 }}", "{{ n % 2 == 0 }}", "{{ name | replace(from='a', to='b') | truncate(length=3, end='.') }}", "{{ t | int + n }}",
        "{{ arr[0] ~ name }}", "{{ name | trim | length }}", "{{ n * 2 - 1 }}", "{{ (n > 1 and n < 9) or not (name == 'x') }}", "{{ name | capitalize }}",
    ]
    rows = [(" ann ", 2, "7", ["p", "q"]), ("bob", 11, "x", ["r"])]
    df = spark.createDataFrame(rows, "name string, n long, t string, arr array<string>")
    found = df.select(*(template.text_column(t).alias(f"c{k}") for k, t in enumerate(texts))).collect()
    for row, got in zip(rows, found, strict=True):
        held = dict(zip(("name", "n", "t", "arr"), row, strict=True))
        assert list(got) == [template.render(t, held) for t in texts]


def test_scope_layers():
    assert scope.fold([{"first": "John"}, {"full": "{{ first }} Doe"}])["full"] == "John Doe"
    assert scope.fold([{"a": 1}, {"a": "{{ a + 1 }}", "b": "{{ a }}"}]) == {"a": 2, "b": 1}
    assert scope.fold([{"x": "true"}, {"y": "{{ x }}", "z": ["{{ x }}"]}]) == {"x": "true", "y": True, "z": [True]}
    with pytest.raises(TemplateError):
        scope.fold([{"a": 1, "b": "{{ c }}"}])


def test_env():
    assert scope.expand_env("$A ${B} ${C:-\"Alice\"} $D", {"A": "1"}, {"B": "2"}) == "1 2 Alice $D"
    assert scope.fold_env([{"A": "x"}, {"B": "$A-y"}, {"A": "z"}], {}) == {"A": "z", "B": "x-y"}


def test_fold_rows(spark):
    rows = [(1, "k", 0, "a"), (1, "k", 2, None), (1, "k", 1, "b"), (2, "k", 0, "c")]
    df = spark.createDataFrame(rows, "node long, key string, depth int, value string")
    assert {(r["node"], r["value"]) for r in scope.fold_rows(df).collect()} == {(1, "b"), (2, "c")}


@pytest.mark.parametrize(("text", "expected"), [
    ("{{ missing is defined }}{{ n is defined }}", "falsetrue"), ("{{ missing is undefined or n is odd }}", "true"), ("{{ n is not even }}", "true"),
    ("{{ 9 is divisibleby(3) and s is starting_with('He') }}", "true"), ("{{ s is containing('z') }}", "false"), ("{{ s is matching('^H.*o$') }}", "true"),
    ("{{ [1] is iterable and n is number and s is string }}", "true"), ("{{ n is strange }}", None), ("{{ s is odd }}", None),
    ("{{ range(end=4, start=1) }}", "[1, 2, 3]"), ("{{ throw(message='no') }}", None), ("{{ get_env(name='NOT_SET_HERE', default='d') }}", "d"),
    ("{{ get_env(name='NOT_SET_HERE') }}", None), ("{{ now(timestamp=true) > 1600000000 }}", "true"), ("{{ get_random(start=3, end=4) }}", "3"),
    ("{{ range(wrong=1) }}", None), ("{{ 0 | date }} {{ '2024-03-01T10:00:00' | date(format='%d.%m. %H') }}", "1970-01-01 01.03. 10"), ("{{ 'x' | date }}", None),
    ("{{ 'Ünder the Sea!' | slugify }}", "under-the-sea"), ("{{ '<b>x</b>' | striptags }}", "x"), ("{{ '<a/>&' | escape }}", "&lt;a&#x2F;&gt;&amp;"),
    ("{{ 'a b/c' | urlencode }}", "a%20b/c"), ("{{ '//x//' | trim_start_matches(pat='/') | trim_end_matches(pat='/') }}", "x"),
    ("{{ 1 | pluralize }}{{ 2 | pluralize }}", "s"), ("{{ 2048 | filesizeformat }}", "2 KiB"), ("{{ rows | map(attribute='a') }}", "[1, 2]"),
    ("{{ rows | filter(attribute='b.c', value='y') | length }}", "1"), ("{{ rows | group_by(attribute='b.c') | json_encode }}", '{"x":[{"a":1,"b":{"c":"x"}}],"y":[{"a":2,"b":{"c":"y"}}]}'),
])
def test_tests_functions_and_filters(text, expected):
    values = {"n": 3, "s": "Hello", "rows": [{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}]}
    if expected is None:
        with pytest.raises(TemplateError):
            template.render(text, values)
    else:
        assert template.render(text, values) == expected

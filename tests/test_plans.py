from datetime import UTC, datetime

import pytest

from grovesift.errors import QueryError
from grovesift.plans import values
from grovesift.plans.ast import And, Everything, Extensions, Folder, Kind, Modified, Not, Or, PathText, Pattern, Plan, Size, Text, Xor
from grovesift.plans.parser import admit, completion, is_structured, matching_commands, parse, query_of_url, suggestions
from grovesift.plans.patterns import compiled

ORDER, ASIA, F_TYPE = Text("order-7"), Folder("/ASIA"), Extensions(("f",))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", Everything()),
        ("order-7", ORDER),
        ("Customer#000000042 order-7", And((Text("Customer#000000042"), ORDER))),
        ('"Customer 42" in:/ASIA', And((Text("Customer 42"), ASIA))),
        ("in:/ASIA/", ASIA),
        ("path:nation_3/customer", PathText("nation_3/customer")),
        ("FILETYPE:f", F_TYPE),
        ("ext:o,p", Extensions(("o", "p"))),
        ("rx:^order-[0-9]+$", Pattern("^order-[0-9]+$")),
        ('regex:"order (f|o)"', Pattern("order (f|o)")),
        ("type:directories", Kind(True)),
        ("size:512..1kb", Size(512, 1024)),
        ("order-7 OR ext:f AND in:/ASIA", Or((ORDER, And((F_TYPE, ASIA))))),
        ("(order-7 OR ext:f) in:/ASIA", And((Or((ORDER, F_TYPE)), ASIA))),
        ("order-7 XOR ext:f OR in:/ASIA", Or((Xor(ORDER, F_TYPE), ASIA))),
        ("order-7 XOR ext:f XOR in:/ASIA", Xor(Xor(ORDER, F_TYPE), ASIA)),
        ("NOT ext:f order-7", And((Not(F_TYPE), ORDER))),
        ("NOT (NOT ext:f)", Not(Not(F_TYPE))),
        ('"OR" OR "("', Or((Text("OR"), Text("(")))),
        ("order-7 limit:3", ORDER),
        ("limit:3 OR order-7", ORDER),
        ("limit:3 XOR limit:4", Everything()),
        ("NOT limit:3", Everything()),
        ("/in /ASIA order-7", And((ORDER, ASIA))),
        ("/filetype f order-7 /or order-8", And((Or((ORDER, Text("order-8"))), F_TYPE))),
        ("/filetype f /or order-7", Or((F_TYPE, ORDER))),
        ("order-7 /or /filetype f order-8", Or((ORDER, And((Text("order-8"), F_TYPE))))),
        ('/not "nation 3" order-7', And((ORDER, Not(PathText("nation 3"))))),
        ("/type folder /type file", Kind(False)),
        ("order /regex [0-9] f", And((Text("order"), Pattern("[0-9] f")))),
    ],
)
def test_trees(text, tree):
    assert parse(text).tree == tree


def test_limits_and_views_of_plans():
    assert parse("limit:3 order-7 limit:5") == Plan(ORDER, 5) and parse("/limit 20000").limit == 10_000
    assert parse("").unconstrained and not parse("order-7").unconstrained
    assert parse("a (b OR c XOR d) NOT e ext:f").terms == ["a", "b", "c", "d"]
    assert parse("order.*", pattern_mode=True).tree == Pattern("order.*") and parse("/in /ASIA x", pattern_mode=True).tree == And((Text("x"), ASIA))


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ('name:"order', "quote"), ("OR order", "OR"), ("order AND", "AND"), ("order XOR OR f", "XOR"), ("in:/ASIA NOT", "NOT"), ("order ()", "parenthes"), ("((order)", "parenthes"), ("order )", ")"),
        ("colour:red", "colour"), ("path:", "path"), ("in:ASIA", "in"), ("ext:f,,o", "filetype"), ('rx:"order("', "order("), ("type:link", "type"), ("size:9..1", "size"), ("modified:2001-13-01", "modified"), ("limit:-4", "limit"),
        ("order /limit", "/limit"), ("/or", "/or"), ("order /or /or f", "/or"), ("order /or", "/or"), ("/colour red", "/colour"), ("order /or f /regex x", "/regex"), ("order /regex", "/regex"), ("/size big", "/size"),
    ],
)
def test_invalid_queries_say_what_is_wrong(text, said):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert said in str(e.value)


def test_values():
    assert values.absolute_path("/") == "/" and values.absolute_path("/ASIA/") == "/ASIA" and values.absolute_path("ASIA") is None and values.absolute_path("~/x").startswith("/")
    assert values.extensions(".f,o.") == ("f", "o") and values.extensions(",f") is None
    assert values.limit("+7") == 7 and values.limit("10001") == 10_000 and values.limit("0") is None and values.limit("7.5") is None
    for text, low, high in [("2kb", 2048, 2048), ("0.5mb", 524288, 524288), (">3gb", 3221225473, None), (">=1", 1, None), ("<1kb", None, 1023), ("<=1tb", None, 1 << 40), ("=0", 0, 0), ("5..5", 5, 5)]:
        assert values.size(text) == Size(low, high)
    assert all(values.size(t) is None for t in ("5..4", "..5", "5..", "+5", "5pb", "1e3", "9999999tb", " "))


def test_dates():
    now = datetime(2003, 5, 6, 7, 8, 9, tzinfo=UTC)
    at = lambda *d: int(datetime(*d, tzinfo=UTC).timestamp())
    assert values.modified("TODAY", now) == Modified(at(2003, 5, 6), at(2003, 5, 7) - 1)
    assert values.modified("30d", now) == Modified(at(2003, 4, 6, 7, 8, 9), None) and values.modified("0d", now) == Modified(at(2003, 5, 6, 7, 8, 9), None)
    assert values.modified("2000-02-28..2000-02-29", now) == Modified(at(2000, 2, 28), at(2000, 3, 1) - 1)
    assert all(values.modified(t, now) is None for t in ("d", "1.5d", "2000-02-30", "2000-1-1", "2000-01-02..2000-01-01", "2000-01-01..", "99999999d"))


def test_helpers():
    assert is_structured("order (f)") and is_structured("colour:x") and is_structured("a OR b") and not is_structured("in order or not /in /ASIA") and not is_structured(":f") and not is_structured('"a OR b"')
    assert matching_commands("order /m") == ["/modified"] and completion("order /m") == "order /modified " and completion("order /") is None and matching_commands("/type ") == [] and len(matching_commands("/")) == 9
    assert suggestions("mod")[0] == "modified:" and "XOR" not in suggestions("") and "XOR" in suggestions("order ") and "OR" not in suggestions("order ( ") and "NOT" in suggestions("order AND ")
    assert query_of_url("files://search?q=in%3A%2FASIA+order", "files") == "in:/ASIA order"
    for bad in ("files://search?q=a&r=b", "file://search?q=a", "files://search?q=", "files://search/x?q=a", "files://search?q=%2", "files://search?q=a#b"):
        with pytest.raises((QueryError, ValueError)):
            query_of_url(bad, "files")
    for bad in ("", "\t", "order\0", "é" * 9000):
        with pytest.raises(QueryError):
            admit(bad)


@pytest.mark.parametrize(
    ("pattern", "ignore", "need"),
    [
        ("order", True, "order"), ("order", False, "order"), ("urder", True, "urder"), ("abc|f", False, None), ("abc|def", False, ("or", ("abc", "def"))), ("abcs?-f", False, ("or", ("abc-f", "abcs-f"))), (r"\.csv\b", False, ".csv"),
        ("[order]", False, None), ("(?i)burden", False, "burden"), ("ab[cd]e", False, ("or", ("abce", "abde"))), ("abcd+x", False, "abc"), ("ab(c|d)*efgh", False, "efgh"), (r"\d+abc.*def", False, ("and", ("abc", "def"))),
        (r"\x41bc", False, "Abc"), (r"\Qa.c\E", False, "a.c"), ("(abc|def)g", False, ("or", ("abcg", "defg"))), ("a{3}b", False, "aaab"), ("(ab){2,}", False, "abab"), ("(?:abc)?", False, None), ("abc(?=def)g", False, "abcg"), ("(abc|.)x", False, None),
        ("über", True, "ber"), ("(abc|def)(ghj|xyz.mno)", False, ("and", (("or", ("ghj", ("and", ("xyz", "mno")))), ("or", ("abc", "def"))))),
    ],
)
def test_what_patterns_need(pattern, ignore, need):
    found = compiled(pattern, ignore)
    assert found.need == need


@pytest.mark.parametrize("pattern", ["(", ")", "a)", "[", "[]", "[a", "*a", "a{2,1}", r"\q", r"\x{110000}", "(?z)", "[z-a]", r"\N{no such name}", "[[:nothing:]]", "(?<n", r"\pq", "\\", "[a&&]"])
def test_what_isnt_a_pattern(pattern):
    with pytest.raises(QueryError):
        compiled(pattern)


def test_java_spelling(spark):
    """(pattern, what it finds as a whole, what it doesn't)."""
    cases = [
        (r"\w+", ["über", "naïve", "x٣", "a_b", "é"], ["a-b", "a b", ""]), (r"\d", ["1", "٣"], ["x", "½"]), (r"\s", [" ", " ", " ", "\t"], ["x", "​"]), (r"[[:alpha:]]+", ["Île", "日本"], ["a1", "-"]),
        (r"[^[:alpha:]]", ["1", "-"], ["é"]), (r"[[:^alpha:]x]", ["1", "x"], ["é"]), (r"[a-z--[aeiou]]", ["b"], ["a", "B", "-"]), (r"[^a-z--[aeiou]]", ["a", "B"], ["b"]), (r"[a-z&&[^m-p]]", ["a", "q"], ["n"]), (r"[[a-f]--[b]--[d]]", ["a", "c"], ["b", "d"]),
        (r"\p{Greek}+", ["Ελλάδα"], ["abc"]), (r"\p{Letter}\P{Lu}", ["ab", "A1"], ["aB", "1a"]), (r"\p{^Lu}", ["a"], ["A"]), (r"\p{script=Cyrillic}", ["ж"], ["z"]), (r"[\p{L}--[a-z]]", ["é", "A"], ["a"]), (r"a\U00000062\x63\x{64}\0145\cA", ["abcde\x01"], ["abcdeA"]),
        (r"\N{LATIN SMALL LETTER E WITH ACUTE}", ["é"], ["e"]), (r"\Qa.b|c\E+", ["a.b|c", "a.b|ccc"], ["axb|c"]), (r"(?x) a b # a remark", ["ab"], ["a b"]), (r"(?x)[ a]", [" ", "a"], [""]), (r"a(?#none)b", ["ab"], []), (r"(?<n>a|b)\k<n>", ["aa", "bb"], ["ab"]), (r"(a)(b)\2\1", ["abba"], ["abab"]),
        (r"(?>a+)b", ["aab"], ["aa"]), (r"(?s).", ["\n"], [""]), (r".", ["x", "😀"], ["\n", " ", "\x85"]), (r"(?:a(?i)b|c)d", ["aBd", "Cd", "abd"], ["Abd", "aBD"]), (r"(?i:a)b", ["Ab"], ["AB"]), (r"a{2}{2}", ["aaaa"], ["aa"]), (r"x*+y", ["xxy"], ["xx"]), (r"\h\v\R", [" \n\r\n", "\t\x0b\n"], ["ab\n"]),
        (r"[]a]+", ["]a"], ["b"]), (r"[a\-z]", ["-"], ["b"]), (r"[a-]", ["-", "a"], ["b"]), (r"[\]\\]", ["]", "\\"], ["a"]), (r"[[a][b]]", ["a", "b"], ["c"]), (r"[&-]", ["&", "-"], ["a"]), (r"\$\^\{", ["$^{"], []),
    ]
    java_ = spark._jvm.java.util.regex.Pattern
    for pattern, good, bad in cases:
        found = java_.compile(compiled(pattern, False).java)
        assert [x for x in good if not found.matcher(x).matches()] == [] and [x for x in bad if found.matcher(x).matches()] == [], pattern
    borders = java_.compile(compiled(r"\bfür\b", True).java)
    assert [bool(borders.matcher(x).find()) for x in ("für", "a FÜR b", "fürs", "éfür", "für-x", "für٣")] == [True, True, False, False, True, False]

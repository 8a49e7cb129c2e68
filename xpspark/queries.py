"""Registered queries over the engine's operators, each with DuckDB SQL for the same rows.

``VALUE`` queries run in the column lane: a table, the columns to keep, and (name, query, SQL expression). ``NODE``
queries run in the node lane over shredded tables and pages.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .engine import Engine
from .functions import indexed
from .sources import serialize, shred, tables
from .sources.catalog import Catalog
from .streaming import runtime

#: The order of an order's items, and a number as JSON texts spell it.
ITEM = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
JSON_NUMBER = "CAST(%s AS VARCHAR)"

#: name: (table, kept columns, [(column, query, SQL)])
VALUE: dict[str, tuple[str, list[str], list[tuple[str, str, str]]]] = {
    "arithmetic": ("lineitem", ["l_orderkey", "l_linenumber"], [
        ("plus", "$l_quantity + $l_linenumber", "l_quantity + l_linenumber"), ("minus", "$l_quantity - $l_linenumber", "l_quantity - l_linenumber"), ("times", "$l_quantity * $l_linenumber", "l_quantity * l_linenumber"),
        ("neg", "-$l_linenumber", "CAST(-l_linenumber AS DOUBLE)"), ("quot", "$l_quantity idiv $l_linenumber", "trunc(l_quantity / l_linenumber)"), ("rest", "$l_quantity mod $l_linenumber", "CAST(CAST(l_quantity AS BIGINT) % l_linenumber AS DOUBLE)"),
        ("by_zero", "string($l_linenumber div 0)", "'INF'"), ("half", "$l_linenumber div 2", "l_linenumber / 2.0"),
    ]),
    "compare_general": ("lineitem", ["l_orderkey", "l_linenumber"], [
        ("eq", "$l_quantity = (1, 5, 50)", "l_quantity IN (1, 5, 50)"), ("lt", "$l_quantity < 10", "l_quantity < 10"), ("ne", "$l_returnflag != 'R'", "l_returnflag <> 'R'"), ("none", "$l_quantity = ()", "false"), ("text", "('A', 'N') = $l_returnflag", "l_returnflag IN ('A', 'N')"), ("nan", "number($l_returnflag) != 1", "true"),
    ]),
    "compare_value": ("lineitem", ["l_orderkey", "l_linenumber"], [
        ("eq", "$l_quantity eq 5", "l_quantity = 5"), ("ge", "$l_quantity ge 25", "l_quantity >= 25"), ("lt", "$l_returnflag lt 'N'", "l_returnflag < 'N'"), ("ne", "$l_linenumber ne 1", "l_linenumber <> 1"), ("le", "$l_linenumber le 2", "l_linenumber <= 2"), ("gt", "$l_linenumber gt 2", "l_linenumber > 2"),
    ]),
    "logic": ("customer", ["c_custkey"], [
        ("both", "$c_acctbal > 0 and $c_mktsegment = 'BUILDING'", "c_acctbal > 0 AND c_mktsegment = 'BUILDING'"), ("either", "$c_acctbal > 0 or $c_mktsegment = 'BUILDING'", "c_acctbal > 0 OR c_mktsegment = 'BUILDING'"), ("neither", "not($c_acctbal > 0)", "NOT c_acctbal > 0"), ("truth", "boolean($c_name) and true() and not(false())", "true"), ("nothing", "boolean(())", "false"),
    ]),
    "control": ("customer", ["c_custkey"], [
        ("kind", "if ($c_acctbal > 5000) then 'rich' else if ($c_acctbal < 0) then 'debt' else 'even'", "CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' ELSE 'even' END"),
        ("bound", "let $k := $c_custkey, $m := $k * 2 return $m + $k", "CAST(c_custkey * 3 AS DOUBLE)"), ("mapped", "sum((1, 2, 3) ! (. * $c_custkey))", "CAST(c_custkey * 6 AS DOUBLE)"), ("arrow", "$c_mktsegment => lower-case() => substring(1, 3)", "substr(lower(c_mktsegment), 1, 3)"),
        ("joined", "$c_name || '/' || $c_custkey", "c_name || '/' || c_custkey"), ("template", "`{$c_mktsegment}: {$c_custkey + 1}`", "c_mktsegment || ': ' || (c_custkey + 1)"),
    ]),
    "ranges": ("lineitem", ["l_orderkey", "l_linenumber"], [
        ("squares", "sum(for $i in 1 to $l_linenumber return $i * $i)", "CAST(list_sum(list_transform(range(1, l_linenumber + 1), lambda i: i * i)) AS DOUBLE)"), ("size", "count(2 to $l_linenumber)", "CAST(l_linenumber - 1 AS DOUBLE)"), ("down", "count(5 to 1)", "CAST(0 AS DOUBLE)"), ("pairs", "count(for $i in 1 to $l_linenumber, $k in 1 to $i return $k)", "CAST(l_linenumber * (l_linenumber + 1) / 2 AS DOUBLE)"),
        ("third", "string((1 to $l_linenumber)[3])", "CASE WHEN l_linenumber >= 3 THEN '3' ELSE '' END"), ("final", "(1 to $l_linenumber)[last()] = $l_linenumber", "true"), ("even", "count((1 to $l_linenumber)[. mod 2 = 0])", "CAST(l_linenumber // 2 AS DOUBLE)"),
    ]),
    "quantified": ("embeddings", ["vec_id"], [
        ("any", "some $x in $embedding?* satisfies $x > 0.3", "len(list_filter(embedding, lambda x: x > 0.3)) > 0"), ("all", "every $x in $embedding?* satisfies $x < 0.3", "len(list_filter(embedding, lambda x: NOT x < 0.3)) = 0"), ("vacuous", "every $x in () satisfies false()", "true"),
    ]),
    "strings": ("documents", ["doc_id"], [
        ("upper", "upper-case($source)", "upper(source)"), ("lower", "lower-case(substring($text, 1, 30))", "lower(substr(text, 1, 30))"), ("size", "string-length($text)", "CAST(length(text) AS DOUBLE)"), ("starts", "starts-with($text, 'The')", "starts_with(text, 'The')"), ("ends", "ends-with($text, '.')", "ends_with(text, '.')"), ("has", "contains($text, ' and ')", "contains(text, ' and ')"),
        ("before", "substring-before($text, ' ')", "CASE WHEN contains(text, ' ') THEN split_part(text, ' ', 1) ELSE '' END"), ("after", "substring-after($text, '. ')", "CASE WHEN contains(text, '. ') THEN substr(text, strpos(text, '. ') + 2) ELSE '' END"), ("part", "substring($text, 0, 5)", "substr(text, 1, 4)"), ("swapped", "translate(substring($text, 1, 40), 'aeiou', 'AEI')", "replace(replace(translate(substr(text, 1, 40), 'aei', 'AEI'), 'o', ''), 'u', '')"),
        ("glued", "string-join(($lang, $source), '-')", "lang || '-' || source"), ("concat", "concat($lang, ':', $doc_id)", "lang || ':' || doc_id"), ("text", "string($n_chars)", "CAST(n_chars AS VARCHAR)"), ("equal", "compare($lang, 'en')", "CASE WHEN lang < 'en' THEN -1.0 WHEN lang = 'en' THEN 0.0 ELSE 1.0 END"),
    ]),
    "strings_whole": ("documents", ["doc_id"], [
        ("lower", "lower-case($text)", "lower(text)"), ("swapped", "translate($text, 'aeiou', 'AEI')", "replace(replace(translate(text, 'aei', 'AEI'), 'o', ''), 'u', '')"),
    ]),
    "spaces": ("documents", ["doc_id"], [("clean", "normalize-space($text)", "trim(regexp_replace(text, '\\s+', ' ', 'g'))")]),
    "regex": ("documents", ["doc_id"], [
        ("hit", "matches($text, '[0-9]{3}')", "regexp_matches(text, '[0-9]{3}')"), ("hit_i", "matches($text, '^THE', 'i')", "regexp_matches(text, '(?i)^THE')"), ("words", "count(tokenize($text, ' '))", "CAST(len(string_split(trim(text, ' '), ' ')) AS DOUBLE)"), ("masked", "replace(substring($text, 1, 60), '[aeiou]', '*')", "regexp_replace(substr(text, 1, 60), '[aeiou]', '*', 'g')"), ("groups", "replace(substring($text, 1, 60), '(t)(h)', '$2$1')", "regexp_replace(substr(text, 1, 60), '(t)(h)', '\\2\\1', 'g')"),
        ("numbers", "count(analyze-string($text, '[0-9]+')[?type = 'match'])", "CAST(len(regexp_extract_all(text, '[0-9]+')) AS DOUBLE)"),
    ]),
    "regex_whole": ("documents", ["doc_id"], [
        ("masked", "replace($text, '[aeiou]', '*')", "regexp_replace(text, '[aeiou]', '*', 'g')"), ("groups", "replace($text, '(t)(h)', '$2$1')", "regexp_replace(text, '(t)(h)', '\\2\\1', 'g')"),
    ]),
    "codes": ("part", ["p_partkey"], [
        ("points", "sum(string-to-codepoints(substring($p_name, 1, 3)))", "CAST(list_sum(list_transform(string_split(substr(p_name, 1, 3), ''), lambda c: unicode(c))) AS DOUBLE)"), ("back", "codepoints-to-string(string-to-codepoints($p_name))", "p_name"), ("uri", "encode-for-uri($p_name)", "url_encode(p_name)"), ("hex", "encode-hex($p_name)", "hex(encode(p_name))"), ("b64", "encode-base64($p_name)", "base64(encode(p_name))"), ("again", "decode-hex(encode-hex($p_name))", "p_name"), ("swap", "hex-to-base64(encode-hex($p_name))", "base64(encode(p_name))"), ("bytes", "binary-length(encode-hex($p_name), 'hex')", "CAST(strlen(p_name) AS DOUBLE)"), ("cut", "binary-substring(encode-hex($p_name), 1, 2, 'hex')", "hex(encode(substr(p_name, 1, 2)))"), ("nfc", "normalize-unicode($p_name)", "p_name"),
    ]),
    "formats": ("part", ["p_partkey"], [
        ("padded", "format-integer($p_partkey, '00001')", "lpad(CAST(p_partkey AS VARCHAR), greatest(5, CAST(length(CAST(p_partkey AS VARCHAR)) AS INT)), '0')"), ("plain", "format-integer($p_partkey, '1')", "CAST(p_partkey AS VARCHAR)"), ("fixed", "format-number($p_size, '0.00')", "CAST(p_size AS VARCHAR) || '.00'"), ("roman", "format-integer(($p_size mod 10) + 1, 'I')", "list_extract(['I','II','III','IV','V','VI','VII','VIII','IX','X'], CAST(p_size % 10 + 1 AS INT))"), ("letter", "format-integer(($p_size mod 26) + 1, 'a')", "chr(CAST(97 + p_size % 26 AS INT))"), ("word", "format-integer($p_size mod 4, 'w')", "list_extract(['zero','one','two','three'], CAST(p_size % 4 + 1 AS INT))"),
    ]),
    "numbers": ("customer", ["c_custkey"], [
        ("abs", "abs($c_acctbal)", "abs(CAST(c_acctbal AS DOUBLE))"), ("up", "ceiling($c_acctbal)", "ceil(CAST(c_acctbal AS DOUBLE))"), ("down", "floor($c_acctbal)", "floor(CAST(c_acctbal AS DOUBLE))"), ("near", "round($c_acctbal)", "floor(CAST(c_acctbal AS DOUBLE) + 0.5)"), ("even", "round-half-to-even($c_custkey div 2)", "round_even(c_custkey / 2.0, 0)"), ("not_a_number", "string(number($c_name))", "'NaN'"), ("number", "number($c_custkey) + number('1')", "CAST(c_custkey + 1 AS DOUBLE)"),
    ]),
    "mathematics": ("part", ["p_partkey"], [
        ("root", "math:sqrt($p_size * $p_size)", "CAST(p_size AS DOUBLE)"), ("square", "math:pow($p_size, 2)", "CAST(p_size * p_size AS DOUBLE)"), ("exp0", "math:exp(0) + math:exp10(2)", "101.0"), ("logs", "math:log(1) + math:log10(100)", "2.0"), ("log0", "string(math:log(0))", "'-INF'"), ("circle", "round(1000 * (math:sin(0) + math:cos(0) + math:tan(0) + math:asin(0) + math:atan(0) + math:atan2(0, 1)))", "1000.0"), ("acos", "round(1000 * math:acos($p_size * 0))", "1571.0"), ("pi", "floor(100 * math:pi())", "314.0"),
    ]),
    "sequences": ("embeddings", ["vec_id"], [
        ("size", "count($embedding?*)", "CAST(len(embedding) AS DOUBLE)"), ("head", "head($embedding?*)", "CAST(embedding[1] AS DOUBLE)"), ("rest", "count(tail($embedding?*))", "CAST(len(embedding) - 1 AS DOUBLE)"), ("back", "reverse($embedding?*)[1]", "CAST(embedding[len(embedding)] AS DOUBLE)"), ("mid", "count(subsequence($embedding?*, 3, 5))", "5.0"), ("more", "count(insert-before($embedding?*, 2, (1, 2)))", "CAST(len(embedding) + 2 AS DOUBLE)"), ("less", "count(remove($embedding?*, 1))", "CAST(len(embedding) - 1 AS DOUBLE)"), ("low", "min($embedding?*)", "CAST(list_min(embedding) AS DOUBLE)"), ("high", "max($embedding?*)", "CAST(list_max(embedding) AS DOUBLE)"), ("none", "empty($embedding?*)", "false"), ("some", "exists($embedding?*)", "true"), ("where", "index-of($embedding?*, $embedding(3))[1]", "CAST(list_position(embedding, embedding[3]) AS DOUBLE)"),
        ("distinct", "count(distinct-values(($label, $label, 99)))", "CASE WHEN label = 99 THEN 1.0 ELSE 2.0 END"), ("same", "deep-equal($embedding, $embedding)", "true"), ("single", "exactly-one($label)", "CAST(label AS DOUBLE)"), ("sorted", "sort($embedding?*)[2]", "CAST(list_sort(embedding)[2] AS DOUBLE)"), ("top", "sort($embedding?*, '', function($x) {-$x})[1]", "CAST(list_max(embedding) AS DOUBLE)"),
    ]),
    "functions": ("embeddings", ["vec_id"], [
        ("mapped", "count(for-each($embedding?*, function($x) {if ($x > 0) then ($x, $x) else ()}))", "CAST(2 * len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE)"), ("kept", "count(filter($embedding?*, function($x) {$x > 0}))", "CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE)"), ("folded", "fold-left($embedding?*, 0, function($a, $x) {$a + (if ($x > 0) then 1 else 0)})", "CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE)"), ("right", "fold-right($embedding?*, 0, function($x, $a) {$a + (if ($x < 0) then 1 else 0)})", "CAST(len(list_filter(embedding, lambda x: x < 0)) AS DOUBLE)"), ("pairs", "count(filter(for-each-pair($embedding?*, tail($embedding?*), function($a, $b) {$a < $b}), function($t) {$t}))", "CAST(len(list_filter(range(1, len(embedding)), lambda i: embedding[i] < embedding[i + 1])) AS DOUBLE)"),
        ("applied", "apply(concat#2, ['n', 'm'])", "'nm'"), ("named", "function-name(abs#1)", "'abs'"), ("arity", "function-arity(function($a, $b) {1})", "2.0"), ("partial", "let $f := function($a, $b) {$a * $b} return $f(?, 3)($label)", "CAST(label * 3 AS DOUBLE)"), ("chosen", "(if ($label > 4) then floor#1 else ceiling#1)(0.5)", "CASE WHEN label > 4 THEN 0.0 ELSE 1.0 END"),
    ]),
    "maps": ("customer", ["c_custkey"], [
        ("got", "map{'k': $c_custkey, 'n': $c_name}?n", "c_name"), ("size", "map:size(map{'a': 1, 'b': 2})", "2.0"), ("keys", "string-join(map:keys(map{'b': 1, '10': 2, '9': 3}), ',')", "'9,10,b'"), ("has", "map:contains(map:entry($c_mktsegment, 1), 'BUILDING')", "c_mktsegment = 'BUILDING'"), ("put", "map:get(map:put(map:entry('a', 1), 'a', $c_custkey), 'a')", "CAST(c_custkey AS DOUBLE)"), ("removed", "map:size(map:remove(map{'a': 1, 'b': 2}, 'a'))", "1.0"), ("merged", "map:merge((map:entry('a', 1), map:entry('a', $c_custkey)))?a", "CAST(c_custkey AS DOUBLE)"), ("first", "map:merge((map:entry('a', 1), map:entry('a', $c_custkey)), map{'duplicates': 'use-first'})?a", "1.0"), ("each", "sum(map:for-each(map{'a': 1, 'b': $c_custkey}, function($k, $v) {$v * 2})?*)", "CAST(2 + 2 * c_custkey AS DOUBLE)"), ("called", "map{'x': $c_custkey}('x')", "CAST(c_custkey AS DOUBLE)"),
    ]),
    "arrays": ("embeddings", ["vec_id"], [
        ("size", "array:size($embedding)", "CAST(len(embedding) AS DOUBLE)"), ("got", "array:get($embedding, 2)", "CAST(embedding[2] AS DOUBLE)"), ("called", "$embedding(2) = $embedding?2", "true"), ("put", "array:put($embedding, 1, 7)?1", "7.0"), ("append", "array:size(array:append($embedding, 1))", "CAST(len(embedding) + 1 AS DOUBLE)"), ("sub", "array:size(array:subarray($embedding, 2, 3))", "3.0"), ("removed", "array:size(array:remove($embedding, (1, 2)))", "CAST(len(embedding) - 2 AS DOUBLE)"), ("inserted", "array:insert-before($embedding, 1, 5)?1", "5.0"), ("head", "array:head($embedding)", "CAST(embedding[1] AS DOUBLE)"), ("tail", "array:size(array:tail($embedding))", "CAST(len(embedding) - 1 AS DOUBLE)"), ("reversed", "array:reverse($embedding)?1", "CAST(embedding[len(embedding)] AS DOUBLE)"), ("joined", "array:size(array:join(($embedding, $embedding)))", "CAST(2 * len(embedding) AS DOUBLE)"), ("flat", "count(array:flatten([[1, 2], [3]]))", "3.0"), ("each", "array:for-each($embedding, function($x) {$x * 0 + 1})?1", "1.0"), ("kept", "array:size(array:filter($embedding, function($x) {$x > 0}))", "CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE)"), ("folded", "array:fold-left([1, 2, 3], $label, function($a, $x) {$a - $x})", "CAST(label - 6 AS DOUBLE)"), ("folded_r", "array:fold-right([1, 2, 3], $label, function($x, $a) {$x + $a})", "CAST(label + 6 AS DOUBLE)"), ("sorted", "array:sort($embedding)?1", "CAST(list_min(embedding) AS DOUBLE)"), ("made", "array:size(array{1 to 4})", "4.0"),
    ]),
    "json": ("events", ["event_id"], [
        ("k", "number(parse-json($props)?k)", "CAST(json_extract(props, '$.k') AS DOUBLE)"), ("more", "parse-json($props)?k + 1", "CAST(json_extract(props, '$.k') AS DOUBLE) + 1"), ("big", "parse-json($props)?k > 50", "CAST(json_extract(props, '$.k') AS BIGINT) > 50"), ("keys", "map:size(parse-json($props))", "1.0"), ("nested", "parse-json('{\"a\": [1, {\"b\": 5}]}')?a?2?b = 5", "true"), ("text", "serialize(parse-json($props))", "replace(props, ' ', '')"), ("missing", "empty(parse-json($props)?zz)", "true"),
    ]),
    "types": ("events", ["event_id"], [
        ("whole", "$value castable as xs:integer", "true"), ("word", "$event_type castable as xs:integer", "false"), ("int", "$event_id instance of xs:integer", "true"), ("dec", "xs:integer($value)", "CAST(trunc(value) AS DOUBLE)"), ("text", "xs:string($user_id)", "CAST(user_id AS VARCHAR)"), ("bool", "xs:boolean('1')", "true"), ("byte", "xs:byte($user_id mod 100)", "CAST(user_id % 100 AS DOUBLE)"), ("treated", "($event_type treat as xs:string) = $event_type", "true"), ("cast", "'12' cast as xs:integer", "12.0"), ("hex", "xs:hexBinary('0aff')", "'0AFF'"), ("prefix", "xs:double('12abc')", "12.0"), ("many", "(1, 2) instance of xs:integer+", "true"), ("arr", "[1] instance of array(xs:integer)", "true"), ("fails", "try { xs:integer($event_type) } catch * { -1 }", "-1.0"), ("year", "xs:gYear('2024')", "'2024'"), ("none", "() instance of empty-sequence()", "true"),
    ]),
    "dates": ("events", ["event_id"], [
        ("year", "year-from-dateTime($ts)", "CAST(year(ts) AS DOUBLE)"), ("month", "month-from-dateTime($ts)", "CAST(month(ts) AS DOUBLE)"), ("day", "day-from-dateTime($ts)", "CAST(day(ts) AS DOUBLE)"), ("hour", "hours-from-dateTime($ts)", "CAST(hour(ts) AS DOUBLE)"), ("minute", "minutes-from-dateTime($ts)", "CAST(minute(ts) AS DOUBLE)"), ("second", "floor(seconds-from-dateTime($ts))", "CAST(second(ts) AS DOUBLE)"), ("next", "string(xs:date('2024-01-31') + xs:duration('P1M'))", "'2024-02-29'"), ("time", "hours-from-time(xs:time('10:20:30'))", "10.0"), ("span", "days-from-duration(xs:duration('P3DT4H'))", "3.0"), ("zone", "string(timezone-from-dateTime('2024-01-01T00:00:00+02:00'))", "'PT2H'"), ("moved", "adjust-dateTime-to-timezone('2024-01-01T00:00:00Z', xs:duration('PT2H'))", "'2024-01-01T02:00:00+02:00'"),
    ]),
    "qnames": ("nation", ["n_nationkey"], [
        ("local", "local-name-from-QName(QName('http://x', 'p:a'))", "'a'"), ("prefix", "prefix-from-QName(QName('http://x', 'p:a'))", "'p'"), ("uri", "namespace-uri-from-QName(QName('http://x', 'a'))", "'http://x'"), ("resolved", "resolve-uri('b', concat('http://x/', $n_nationkey, '/'))", "'http://x/' || n_nationkey || '/b'"), ("iri", "iri-to-uri('http://x/a b')", "'http://x/a%20b'"), ("csv", "parse-csv(concat('a,', $n_nationkey))?1?2", "CAST(n_nationkey AS VARCHAR)"), ("out", "serialize-csv(['a', 'b,c'])", "'a,\"b,c\"'"),
    ]),
    "aggregates": ("embeddings", ["vec_id"], [
        ("total", "round(1000 * sum($embedding?*))", "floor(1000 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 0.5)"), ("mean", "round(1000 * avg($embedding?*))", "floor(1000 * (list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding)) + 0.5)"), ("skips", "sum((1, number('x'), $label))", "CAST(1 + label AS DOUBLE)"), ("nothing", "sum(())", "0.0"), ("n", "count((1, 2, $label))", "3.0"),
    ]),
    "constructors": ("events", ["event_id"], [
        ("decimal", "xs:decimal('1.5')", "1.5"), ("float", "xs:float('2.5')", "2.5"), ("datetime", "string(xs:dateTime('2024-02-03T04:05:06'))", "'2024-02-03T04:05:06'"), ("uri", "xs:anyURI('http://x/y')", "'http://x/y'"), ("qname", "xs:QName('p:a')", "'p:a'"), ("untyped", "xs:untypedAtomic($event_type)", "event_type"),
        ("year_month", "xs:gYearMonth('2024-02')", "'2024-02'"), ("month_day", "xs:gMonthDay('--02-29')", "'--02-29'"), ("g_day", "xs:gDay('---05')", "'---05'"), ("g_month", "xs:gMonth('--02')", "'--02'"), ("b64", "xs:base64Binary('SGk=')", "'SGk='"),
        ("long", "xs:long($user_id)", "CAST(user_id AS DOUBLE)"), ("int", "xs:int($user_id)", "CAST(user_id AS DOUBLE)"), ("short", "xs:short($user_id mod 1000)", "CAST(user_id % 1000 AS DOUBLE)"), ("not_positive", "xs:nonPositiveInteger(-$user_id)", "CAST(-user_id AS DOUBLE)"), ("negative", "xs:negativeInteger(-$user_id - 1)", "CAST(-user_id - 1 AS DOUBLE)"), ("not_negative", "xs:nonNegativeInteger($user_id)", "CAST(user_id AS DOUBLE)"), ("positive", "xs:positiveInteger($user_id + 1)", "CAST(user_id + 1 AS DOUBLE)"),
        ("u_long", "xs:unsignedLong($user_id)", "CAST(user_id AS DOUBLE)"), ("u_int", "xs:unsignedInt($user_id)", "CAST(user_id AS DOUBLE)"), ("u_short", "xs:unsignedShort($user_id mod 1000)", "CAST(user_id % 1000 AS DOUBLE)"), ("u_byte", "xs:unsignedByte($user_id mod 200)", "CAST(user_id % 200 AS DOUBLE)"), ("too_large", "try { xs:byte($user_id + 128) } catch * { -1 }", "-1.0"), ("string", "xs:string($event_type)", "event_type"), ("double", "xs:double(string($user_id))", "CAST(user_id AS DOUBLE)"), ("time", "xs:time('10:20:30')", "'10:20:30'"), ("duration", "xs:duration('P1DT2H')", "'P1DT2H'"), ("cast", "string($user_id) cast as xs:integer", "CAST(user_id AS DOUBLE)"),
    ]),
    "dates_parts": ("events", ["event_id"], [
        ("year", "year-from-date(xs:date($ts))", "CAST(year(ts) AS DOUBLE)"), ("month", "month-from-date(xs:date($ts))", "CAST(month(ts) AS DOUBLE)"), ("day", "day-from-date(xs:date($ts))", "CAST(day(ts) AS DOUBLE)"), ("zone", "string(timezone-from-date('2024-02-03Z'))", "'PT0S'"), ("minutes", "minutes-from-time(xs:time('10:20:30'))", "20.0"), ("seconds", "seconds-from-time(xs:time('10:20:30.5'))", "30.5"), ("zone_time", "string(timezone-from-time('10:00:00+01:30'))", "'PT1H30M'"),
        ("years", "years-from-duration(xs:duration('P2Y3M'))", "2.0"), ("months", "months-from-duration(xs:duration('P2Y3M'))", "3.0"), ("hours", "hours-from-duration(xs:duration('P1DT5H6M7S'))", "5.0"), ("mins", "minutes-from-duration(xs:duration('P1DT5H6M7S'))", "6.0"), ("secs", "seconds-from-duration(xs:duration('PT7.5S'))", "7.5"), ("date_moved", "adjust-date-to-timezone('2024-01-01Z', xs:duration('PT2H'))", "'2024-01-01+02:00'"), ("time_moved", "adjust-time-to-timezone('10:00:00Z', xs:duration('-PT1H'))", "'09:00:00-01:00'"), ("implicit", "string(implicit-timezone())", "'PT0S'"),
        ("now", "year-from-dateTime(current-dateTime()) > 2000 and year-from-date(current-date()) > 2000", "true"), ("clock", "matches(string(current-time()), '^[0-9:]+$')", "true"), ("later", "string(xs:date($ts) + xs:duration('P1M'))", "strftime(CAST(ts AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    ]),
    "binary": ("part", ["p_partkey"], [
        ("hex", "base64-to-hex(encode-base64($p_name))", "hex(encode(p_name))"), ("text", "decode-base64(encode-base64($p_name))", "p_name"), ("joined", "binary-concat((encode-hex($p_name), '00'), 'hex')", "hex(encode(p_name)) || '00'"), ("size", "binary-length(encode-base64($p_name), 'base64')", "CAST(strlen(p_name) AS DOUBLE)"),
    ]),
    "cardinality": ("nation", ["n_nationkey"], [
        ("most", "zero-or-one($n_name)", "n_name"), ("none", "empty(zero-or-one(()))", "true"), ("least", "count(one-or-more(($n_name, 'x')))", "2.0"), ("any", "count(unordered((1, 2, 3)))", "3.0"), ("data", "data($n_name)", "n_name"), ("html", "escape-html-uri('http://x/a b')", "'http://x/a%20b'"), ("unset", "empty(environment-variable('NO_SUCH_VARIABLE_HERE'))", "true"), ("set", "exists(available-environment-variables())", "true"), ("group", "count(current-group())", "0.0"), ("key", "current-grouping-key()", "''"),
        ("kinds", "count(distinct-values((1, '1')))", "2.0"), ("big", "string(100000000000000000000)", "'100000000000000000000'"), ("version", "system-property('xsl:version')", "'3.0'"), ("known", "function-available('concat') and not(function-available('no-such'))", "true"), ("element", "element-available('xsl:if')", "false"), ("entity", "unparsed-entity-uri('x')", "''"),
    ]),
    "trees": ("events", ["event_id"], [
        ("xml", "json-to-xml($props)", "'<root><k>' || json_extract_string(props, '$.k') || '</k></root>'"), ("json", "xml-to-json(json-to-xml($props))", "'{\"k\": ' || json_extract_string(props, '$.k') || '}'"), ("yaml", "number(parse-yaml(concat('k: ', $user_id))?k)", "CAST(user_id AS DOUBLE)"), ("back", "serialize-yaml(map{'a': $event_type})", "'a: ' || event_type"),
    ]),
}

#: name: (documents, nodes selected, SQL); the result is doc_id, value, the selected nodes' string values.
PATHS: dict[str, tuple[str, str, str]] = {
    "path_child": ("geography", "/nation/@name", "SELECT n_nationkey AS doc_id, n_name AS value FROM nation"),
    "path_descendant_predicate": ("geography", "//nation[customer/@acctbal > 9000]/@name", "SELECT n_nationkey AS doc_id, n_name AS value FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)"),
    "path_attribute_equals": ("geography", "//customer[@mktsegment = 'BUILDING']/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "path_name_any": ("geography", "/nation/*[@acctbal < 0]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0"),
    "predicate_first": ("geography", "//customer/order[1]/@key", "SELECT c_nationkey AS doc_id, CAST(min(o_orderkey) AS VARCHAR) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey"),
    "predicate_last": ("geography", "/nation/customer[last()]/@key", "SELECT c_nationkey AS doc_id, CAST(max(c_custkey) AS VARCHAR) AS value FROM customer GROUP BY c_nationkey"),
    "predicate_position": ("orders", "/order/lineitem[position() = 2][@quantity > 25]/@linenumber", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE n = 2 AND l_quantity > 25"),
    "filter_whole_sequence": ("geography", "(//order)[3]/@key", "SELECT c_nationkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n = 3"),
    "axis_parent": ("geography", "//order[@totalprice > 200000]/../@key", "SELECT DISTINCT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000"),
    "axis_ancestor": ("geography", "//order[@totalprice > 300000]/ancestor::nation/@name", "SELECT DISTINCT n_nationkey AS doc_id, n_name AS value FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "axis_self": ("geography", "//customer/self::customer[@acctbal > 9900]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 9900"),
    "axis_descendant_or_self": ("geography", "//customer[@acctbal > 9900]/descendant-or-self::order/@key", "SELECT c_nationkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9900"),
    "set_union": ("geography", "//customer[@acctbal > 9000]/@key | //customer[@mktsegment = 'BUILDING']/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING'"),
    "set_intersect": ("geography", "//customer[@acctbal > 5000]/@key intersect //customer[@mktsegment = 'BUILDING']/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "set_except": ("geography", "//customer[@acctbal > 5000]/@key except //customer[@mktsegment = 'BUILDING']/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"),
    "anti_join": ("geography", "//customer[not(order[@totalprice > 100000])]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "count_existence": ("geography", "//customer[count(order) > 0]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "quantified_some": ("orders", "/order[some $l in lineitem satisfies $l/@quantity > 49]/@key", "SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)"),
    "quantified_every": ("orders", "/order[every $l in lineitem satisfies $l/@quantity > 20]/@key", "SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE NOT l_quantity > 20)"),
    "value_join": ("geography", "//customer[@acctbal < 0][@key = //order[@totalprice > 150000]/../@key]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)"),
    "predicate_count": ("geography", "//customer[count(order) >= 15]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 15)"),
    "predicate_or": ("geography", "//customer[@acctbal > 9900 or order/@totalprice > 400000]/@key", "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 9900 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
}

#: name: (documents, query, options, SQL); the result is doc_id, value of the items of expressions over nodes.
ITEMS: dict[str, tuple[str, str, dict, str]] = {
    "predicate_variable": ("geography", "/nation/customer[$n]/@key", {"variables": {"n": 2}}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 2"),
    "predicate_function": ("geography", "/nation/customer[string-length(@mktsegment)]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = length(c_mktsegment)"),
    "predicate_aggregate": ("geography", "/nation/customer[count(order)]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n = k"),
    "sequence_order": ("geography", "(//order, //customer)[1]/@key", {}, "SELECT doc_id, CAST(k AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY branch, c, k) AS n FROM (SELECT c_nationkey AS doc_id, 0 AS branch, c_custkey AS c, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_nationkey, 1, c_custkey, c_custkey FROM customer)) WHERE n = 1"),
    "reverse_nodes": ("geography", "reverse(//customer)[position() <= 2]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer) WHERE n <= 2"),
    "sort_nodes": ("geography", "sort(//customer, (), function($c) { number($c/@acctbal) })[1]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n = 1"),
    "preceding_position": ("geography", "/nation/customer[last()]/preceding::*[1]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = first), first) AS VARCHAR) AS value FROM (SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1 HAVING count(*) > 1)"),
    "sibling_position": ("geography", "//customer[@acctbal > 9000]/following-sibling::customer[1]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(following AS VARCHAR) AS value FROM (SELECT *, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS following FROM customer) WHERE c_acctbal > 9000 AND following IS NOT NULL"),
    "for_join": ("geography", "for $c in //customer[@acctbal > 9000], $o in //order return if ($o/../@key = $c/@key) then concat($c/@name, ':', $o/@key) else ()", {}, "SELECT c_nationkey AS doc_id, c_name || ':' || o_orderkey AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000"),
    "for_theta": ("geography", "for $a in //customer[@acctbal > 9000], $b in //customer[@acctbal > $a/@acctbal] return concat($a/@key, '<', $b/@key)", {}, "SELECT a.c_nationkey AS doc_id, a.c_custkey || '<' || b.c_custkey AS value FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_acctbal > a.c_acctbal WHERE a.c_acctbal > 9000"),
    "for_nodes": ("geography", "for $c in //customer[@acctbal > 9500] return $c/order/@key", {}, "SELECT c_nationkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9500"),
    "if_nodes": ("geography", "if (//customer[@acctbal > 9900]) then //customer[@acctbal > 9900]/@key else /nation/@name", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "let_nodes": ("geography", "let $rich := //customer[@acctbal > 9000], $n := count($rich) return $rich[@mktsegment = 'BUILDING']/concat(@key, '/', $n)", {}, "SELECT c_nationkey AS doc_id, c_custkey || '/' || count(*) OVER (PARTITION BY c_nationkey) AS value FROM customer WHERE c_acctbal > 9000 QUALIFY c_mktsegment = 'BUILDING'"),
    "simple_map_nodes": ("geography", "//customer[@acctbal > 9000] ! concat(@key, '/', count(order))", {}, "SELECT c_nationkey AS doc_id, c_custkey || '/' || count(o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY c_nationkey, c_custkey"),
    "path_values": ("geography", "//customer[@acctbal > 9500]/string(@name)", {}, "SELECT c_nationkey AS doc_id, c_name AS value FROM customer WHERE c_acctbal > 9500"),
    "subsequence_nodes": ("geography", "subsequence(//customer, 2, 2)/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n IN (2, 3)"),
    "distinct_nodes": ("geography", "distinct-values(//customer/@mktsegment)", {}, "SELECT DISTINCT c_nationkey AS doc_id, c_mktsegment AS value FROM customer"),
    "key_lookup": ("geography", "key('segment', 'BUILDING')[@acctbal > 5000]/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "copies": ("geography", "copy-of(//customer[@acctbal > 9500])/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal > 9500"),
    "doc_by_address": ("geography", "doc('nation/3')//customer[@acctbal > 5000]/@key", {"scope": "all"}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_nationkey = 3 AND c_acctbal > 5000"),
    "collection_join": ("geography", "for $a in collection('region 2')//customer[@acctbal > 9000], $b in collection('region 3')//customer[@acctbal > 9000][@mktsegment = $a/@mktsegment] return concat($a/@key, '-', $b/@key)", {"scope": "all"}, "SELECT CAST(NULL AS BIGINT) AS doc_id, a.c_custkey || '-' || b.c_custkey AS value FROM customer a JOIN nation m ON m.n_nationkey = a.c_nationkey JOIN customer b ON b.c_mktsegment = a.c_mktsegment JOIN nation n ON n.n_nationkey = b.c_nationkey WHERE m.n_regionkey = 2 AND n.n_regionkey = 3 AND a.c_acctbal > 9000 AND b.c_acctbal > 9000"),
    "count_documents": ("geography", "count(//order)", {}, "SELECT n_nationkey AS doc_id, CAST(count(o_orderkey) AS VARCHAR) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "attributes_any": ("orders", "/order[@totalprice > 400000]/@*", {}, "SELECT o_orderkey AS doc_id, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR)]) AS value FROM orders WHERE o_totalprice > 400000"),
    "axis_ancestor_or_self": ("geography", "//order[@totalprice > 400000]/ancestor-or-self::*/@key", {}, "SELECT doc_id, value FROM (SELECT DISTINCT c_nationkey AS doc_id, 'o' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 UNION SELECT c_nationkey, 'c' || c_custkey, CAST(c_custkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 UNION SELECT c_nationkey, 'n', CAST(c_nationkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000)"),
    "axis_self_and_siblings": ("geography", "/nation/customer[last()]/self-and-siblings::customer/@key", {}, "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer"),
    "tests_of_kinds": ("markup", "//text() | //comment() | //processing-instruction('go') | //p:*/@p:k | //element(b) | /document-node(element(a))", {"namespaces": {"p": "urn:x"}}, "SELECT n_nationkey AS doc_id, unnest([n_name, 'c' || n_nationkey, 'now', CAST(n_nationkey AS VARCHAR), n_name]) AS value FROM nation"),
    "namespace_nodes": ("markup", "//b/namespace::*", {}, "SELECT n_nationkey AS doc_id, unnest(['urn:x', 'http://www.w3.org/XML/1998/namespace']) AS value FROM nation"),
}

#: name: (documents, nodes, queries per node, SQL); the result has the queries' columns.
TABLES: dict[str, tuple[str, str, dict[str, str], str]] = {
    "axis_following_sibling": ("geography", "//customer[@acctbal > 9500]", {"k": "string(@key)", "n": "count(following-sibling::customer)"}, "SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(n AS DOUBLE) AS n FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM customer) WHERE c_acctbal > 9500"),
    "axis_preceding_sibling": ("geography", "//customer[@acctbal > 9500]", {"k": "string(@key)", "n": "count(preceding-sibling::customer)"}, "SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(n AS DOUBLE) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer) WHERE c_acctbal > 9500"),
    "axis_following": ("geography", "//customer[@acctbal > 9900]", {"k": "string(@key)", "n": "count(following::order)"}, "SELECT CAST(c.c_custkey AS VARCHAR) AS k, CAST((SELECT count(*) FROM orders JOIN customer d ON o_custkey = d.c_custkey WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey > c.c_custkey) AS DOUBLE) AS n FROM customer c WHERE c_acctbal > 9900"),
    "axis_preceding": ("geography", "//customer[@acctbal > 9900]", {"k": "string(@key)", "n": "count(preceding::order)"}, "SELECT CAST(c.c_custkey AS VARCHAR) AS k, CAST((SELECT count(*) FROM orders JOIN customer d ON o_custkey = d.c_custkey WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey < c.c_custkey) AS DOUBLE) AS n FROM customer c WHERE c_acctbal > 9900"),
    "node_functions": ("geography", "//customer[@acctbal > 9000]", {"n": "name()", "l": "local-name()", "u": "namespace-uri()", "kids": "has-children()", "up": "name(..)", "first": "name(@*)", "a": "number(@acctbal)"}, "SELECT 'customer' AS n, 'customer' AS l, '' AS u, true AS kids, 'nation' AS up, 'key' AS first, CAST(c_acctbal AS DOUBLE) AS a FROM customer WHERE c_acctbal > 9000"),
    "node_aggregates": ("orders", "/order", {"k": "string(@key)", "n": "count(lineitem)", "total": "round(100 * sum(lineitem/@extendedprice))", "low": "min(lineitem/@quantity)", "high": "max(lineitem/@quantity)", "mean": "round(100 * avg(lineitem/@quantity))"}, "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(count(l_orderkey) AS DOUBLE) AS n, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS DOUBLE), 0) AS total, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, floor(100 * CAST(sum(l_quantity) AS DOUBLE) / count(l_orderkey) + 0.5) AS mean FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "node_strings": ("orders", "/order[@totalprice > 100000]", {"k": "string(@key)", "flags": "string-join(lineitem/@returnflag, ',')", "any": "exists(lineitem[@returnflag = 'R'])", "first": "string(lineitem[1]/@quantity = lineitem[1]/@quantity)"}, "SELECT CAST(o_orderkey AS VARCHAR) AS k, coalesce(string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate), '') AS flags, coalesce(bool_or(l_returnflag = 'R'), false) AS \"any\", CASE WHEN count(l_orderkey) > 0 THEN 'true' ELSE 'false' END AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 100000 GROUP BY o_orderkey"),
    "node_properties": ("geography", "//customer[@acctbal > 9500]", {"k": "string(@key)", "path": "path()", "same": "generate-id() = generate-id(.)", "top": "count(root(.)/nation)", "base": "base-uri()", "nil": "nilled()", "nm": "node-name()", "scope": "string-join(in-scope-prefixes(.), ',')", "xml": "namespace-uri-for-prefix('xml', .)", "uri": "empty(document-uri(.))", "data": "string(data(@key))"}, "SELECT CAST(c_custkey AS VARCHAR) AS k, '/nation/customer' || CASE WHEN size > 1 THEN '[' || n || ']' ELSE '' END AS path, true AS same, CAST(1 AS DOUBLE) AS top, '' AS base, false AS nil, 'customer' AS nm, 'xml' AS scope, 'http://www.w3.org/XML/1998/namespace' AS xml, true AS uri, CAST(c_custkey AS VARCHAR) AS data FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer) WHERE c_acctbal > 9500"),
    "running_values": ("orders", "//lineitem", {"k": "string(../@key)", "line": "string(@linenumber)", "before": "accumulator-before('quantity')", "after": "accumulator-after('quantity')"}, f"SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS VARCHAR) AS line, CAST(coalesce(sum(l_quantity) OVER w, 0) AS DOUBLE) AS before, CAST(coalesce(sum(l_quantity) OVER w, 0) AS DOUBLE) AS after FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ITEM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "html_links": ("pages", "//a[@href]", {"href": "string(@href)"}, "SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"),
    "html_items": ("pages", "/html", {"n": "count(.//nav//li)", "lang": "string(@lang)"}, "SELECT CAST(len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>')) AS DOUBLE) AS n, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages"),
}

FLWOR: dict[str, tuple[str, str, str]] = {
    "for_count": ("geography", "for $c in //customer return count($c/order)", "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(count(o_orderkey) AS DOUBLE) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey"),
    "group_by_value": ("orders", "for $k in distinct-values(//lineitem/@returnflag) return count(//lineitem[@returnflag = $k])", "SELECT l_returnflag AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1"),
}


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "markup":
        nation = tables.table(spark, sf_dir, "nation")
        text = F.format_string('<p:a xmlns:p="urn:x" xmlns="urn:y" p:k="%s"><b xmlns="">%s</b><!--c%s--><?go now?></p:a>', "n_nationkey", "n_name", "n_nationkey")
        return shred.shred(nation.select("n_nationkey", text.alias("text")), "xml", "n_nationkey", "text")
    if name == "pages":
        return shred.shred(tables.table(spark, sf_dir, "pages"), "html", "page_id", "html")
    return getattr(tables, name)(spark, sf_dir)


def value_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, keep, columns = VALUE[name]
    return Engine(spark).select(tables.table(spark, sf_dir, source), keep, **{c: q for c, q, _ in columns})


def path_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, query, _ = PATHS[name]
    return Engine(spark).nodes(documents(spark, sf_dir, source), query).select("doc_id", F.col("str_val").alias("value"))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that knows the nations' documents by address and region, a key and an accumulator."""
    e = Engine(spark)
    nation = tables.table(spark, sf_dir, "nation")
    known = nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("nation/"), "n_nationkey").alias("uri"), F.concat(F.lit("region "), "n_regionkey").alias("collection"))
    e.catalog = Catalog(known, known)
    e.key("segment", "customer", "@mktsegment")
    e.accumulators.append(runtime.Accumulator("quantity", (F.col("kind") == 2) & (F.col("name") == "quantity"), F.col("str_val").cast("double")))
    return e


def items_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, query, options, _ = ITEMS[name]
    found = engine(spark, sf_dir).nodes(documents(spark, sf_dir, source), query, **options)
    return found.select("doc_id", F.col("str_val").alias("value"))


def table_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, each, columns, _ = TABLES[name]
    return engine(spark, sf_dir).table(documents(spark, sf_dir, source), each, columns).drop("doc_id", "pre")


def flwor_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, query, _ = FLWOR[name]
    out = Engine(spark).flwor(documents(spark, sf_dir, source), query)
    return out.drop("pre")


def accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum of quantities over each order's document."""
    nodes = tables.orders(spark, sf_dir).where((F.col("kind") == 2) & F.col("name").isin("quantity", "linenumber"))
    rule = runtime.Accumulator("q", F.col("name") == "quantity", F.col("str_val").cast("double"))
    rows = runtime.accumulate(nodes, [rule]).where("name = 'quantity'")
    return rows.select("doc_id", F.col("q_before").alias("before"), F.col("q_after").alias("after"))


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; the pattern lets a single file stand for a folder."""
    return spark.readStream.schema(tables.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type of the events as a stream."""
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return runtime.tumbling_counts(spark, events, "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type in windows of an hour that begin every half hour."""
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return runtime.sliding_counts(spark, events, "ts", "event_type", "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end after an hour without events."""
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return runtime.session_counts(spark, events, "ts", "user_id", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters said in a conversation before and after each turn, from turns as a stream."""
    turns = stream_of(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("pre"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("size"))
    return runtime.run_accumulator(spark, turns, lambda total, row: total + row["size"])


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character sets that pages name, from pages as a stream."""
    pages = stream_of(spark, sf_dir, "pages")
    found = runtime.select_stream(spark, pages, "html", "page_id", "html", "/html/head/meta[@charset]/@charset")
    return found.select("doc_id", F.col("str_val").alias("value"))


def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's document with its items as XML."""
    return serialize.serialize(tables.orders(spark, sf_dir)).select("doc_id", "text")


def nodes_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's document with its items as JSON."""
    return serialize.xml_to_json(tables.orders(spark, sf_dir))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json-to-xml of event properties, then a path."""
    nodes = shred.shred(tables.table(spark, sf_dir, "events"), "json", "event_id", "props")
    return Engine(spark).nodes(nodes, "/root/k").select("doc_id", F.col("str_val").alias("value"))


def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance is out of bounds."""
    bounds = schema.SimpleType("double", {"minInclusive": 0.0, "maxInclusive": 9000.0})
    declared = schema.Schema(attributes={"acctbal": schema.Declaration("acctbal", bounds)})
    rows = schema.validate(tables.geography(spark, sf_dir), declared).where("name = 'acctbal'")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((~F.col("is_valid")).cast("long")).alias("invalid"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite-key and range lookups."""
    t = functools.partial(tables.table, spark, sf_dir)
    keys = t("orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return indexed.by_range(indexed.by_key(t("lineitem"), keys, "l_orderkey"), "l_quantity", 10, 20).select("l_orderkey", "l_linenumber", "l_quantity")


def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties to YAML and back."""
    events = tables.table(spark, sf_dir, "events")
    back = serialize.yaml_to_json(serialize.json_to_yaml(F.col("props")))
    return events.select("event_id", F.get_json_object(back, "$.k").cast("long").alias("k"))


#: name: (query, SQL)
OTHER: dict[str, tuple[Callable, str]] = {
    "accumulators": (accumulators, "SELECT l_orderkey AS doc_id, CAST(coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before, CAST(sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"),
    "stream_windows": (stream_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sliding": (stream_sliding, "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CAST(coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR, true) AS INT) AS begins FROM events)) GROUP BY user_id, session"),
    "stream_accumulator": (stream_accumulator, "SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS pre, CAST(coalesce(sum(length(coalesce(text, ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before, CAST(sum(length(coalesce(text, ''))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "stream_documents": (stream_documents, "SELECT page_id AS doc_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS value FROM pages WHERE contains(html, '<meta charset=')"),
    "serialized": (serialized, f"SELECT o_orderkey AS doc_id, '<order key=\"' || o_orderkey || '\" totalprice=\"' || o_totalprice || CASE WHEN items IS NULL THEN '\"/>' ELSE '\">' || items || '</order>' END AS text FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('<lineitem linenumber=\"' || l_linenumber || '\" quantity=\"' || l_quantity || '\" extendedprice=\"' || l_extendedprice || '\" returnflag=\"' || l_returnflag || '\"/>', '' ORDER BY {ITEM}) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "nodes_to_json": (nodes_to_json, f"SELECT o_orderkey AS doc_id, '{{\"@key\": ' || o_orderkey || ', \"@totalprice\": ' || {JSON_NUMBER % 'o_totalprice'} || coalesce(', \"lineitem\": ' || items, '') || '}}' AS json FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN n > 1 THEN '[' || items || ']' ELSE items END AS items FROM (SELECT l_orderkey, count(*) AS n, string_agg('{{\"@linenumber\": ' || l_linenumber || ', \"@quantity\": ' || {JSON_NUMBER % 'l_quantity'} || ', \"@extendedprice\": ' || {JSON_NUMBER % 'l_extendedprice'} || ', \"@returnflag\": \"' || l_returnflag || '\"}}', ', ' ORDER BY {ITEM}) AS items FROM lineitem GROUP BY 1)) ON l_orderkey = o_orderkey"),
    "json_documents": (json_documents, "SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS value FROM events"),
    "schema_validation": (schema_validation, "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) AS n, count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) AS invalid FROM customer GROUP BY 1"),
    "lookups": (lookups, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) AND l_quantity BETWEEN 10 AND 20"),
    "yaml_round_trip": (yaml_round_trip, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable] = {}
    for kind, run in ((PATHS, path_query), (VALUE, value_query), (ITEMS, items_query), (TABLES, table_query), (FLWOR, flwor_query)):
        found |= {name: functools.partial(run, name) for name in kind}
    return found | {name: run for name, (run, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, _, sql) in PATHS.items()} | {name: sql for name, (_, _, _, sql) in ITEMS.items()} | {name: sql for name, (_, _, _, sql) in TABLES.items()} | {name: sql for name, (_, _, sql) in FLWOR.items()} | {name: sql for name, (_, sql) in OTHER.items()}
    for name, (source, keep, columns) in VALUE.items():
        # a number like 2.0 is a DECIMAL in the SQL dialect: it is spelled as a DOUBLE
        typed = [(c, re.sub(r"(?<![\w.'])(-?\d+\.\d+)(?![\w.'])", r"\1e0", sql)) for c, _, sql in columns]
        found[name] = f"SELECT {', '.join(keep)}, " + ", ".join(f'{sql} AS "{c}"' for c, sql in typed) + f" FROM {source}"
    return found

"""Configuration files of projects, and answers that a terminal wrapped."""

import json

import pytest

from quarrylake.functions.terminal import cut_words, last_answer, width
from quarrylake.operators.imports import js_modules
from quarrylake.operators.projects import path_aliases, project_info


def info(spark, files):
    return project_info(spark.createDataFrame(files, "path string, text string"))


def test_nothing_to_read(spark):
    assert info(spark, []).collect() == []
    odd = [("tsconfig.json", None), ("a/tsconfig.json", ""), ("b/package.json", "[]"), ("go.mod", ""), (None, "{}"), ("c/package.json", '{"name": null}')]
    assert info(spark, odd).collect() == []


def test_comments_stay_in_strings(spark):
    text = '{"compilerOptions": {"baseUrl": "x//y", /* "baseUrl": "no" */ "paths": {"a\\"//": ["b,]", "/*c*/"],}, }, } // end'
    (row,) = info(spark, [("jsconfig.json", text)]).collect()
    assert (row["base"], row["paths"]) == ("x/y", [('a"//', ["b,]", "/*c*/"])])


def test_circles_and_long_strings_end(spark):
    long = json.dumps({"extends": "./b", "note": "y" * 200_000 + '\\"' * 50_000, "compilerOptions": {"paths": {"p": ["q"]}}})
    files = [("tsconfig.json", long), ("b.json", '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "src"}}')]
    (row,) = info(spark, files).collect()
    assert (row["base"], row["paths"], row["paths_dir"]) == ("src", [("p", ["q"])], "")


def test_aliases_reach_the_import_rules(spark):
    files = [("web/tsconfig.json", '{"extends": "../base"}'), ("base.json", '{"compilerOptions": {"paths": {"@/*": ["none/*", "lib/*"]}}}'), ("web/package.json", '{"name": "web"}')]
    found = info(spark, files)
    packages = found.filter("kind = 'package'").select("name", "dir")
    imports = spark.createDataFrame([(1, "web/app.ts", "@/tool")], "ref long, path string, spec string")
    held = spark.createDataFrame([("lib/tool.ts",), ("web/app.ts",)], "path string")
    assert [tuple(r) for r in js_modules(imports, held, path_aliases(found), packages).collect()] == [(1, "lib/tool.ts")]


@pytest.mark.parametrize("columns", [60, 80, 100])
def test_wrapped_answers_come_back(columns):
    """Words move down whole, one that is wider than a line is cut: a round trip at several widths."""
    said = {"long": "z" * 250, "text": " ".join(f"word{n}" for n in range(60)), "path": "a/" * 70, "quote": 'he said "no" \\ twice ' * 9}
    line, lines = "", []
    for word in json.dumps(said).split(" "):
        whole = f"{line} {word}" if line else word
        if len(whole) <= columns:
            line = whole
            continue
        if len(word) <= columns:
            lines.append(line)
            line = word
            continue
        while len(whole) > columns:
            lines.append(whole[:columns])
            whole = whole[columns:]
        line = whole
    text = "\n".join([*lines, line])
    assert cut_words(text) and json.loads(last_answer("log\n" + text + "\ndone")) == said


def test_texts_without_an_answer():
    assert [last_answer(t) for t in ("", "{", "{\n", '{"a": "\n', "}{\n", "{" * 200)] == [None] * 6
    assert last_answer('{"a": 1}\n{"b": \n 2} tail {"c"') == '{"b": 2}'
    assert width("") == 0 and cut_words("") == set()

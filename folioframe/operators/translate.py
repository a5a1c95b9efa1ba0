"""Dictionaries, routing, translation steps and their prompts."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from folioframe.functions import language as L
from folioframe.functions import text as T
from folioframe.operators.ranking import ranked
from folioframe.session import broadcast_if_few, cut_lineage

#: Word characters, digits and word boundaries of a pattern are Unicode ones.
_UNICODE = "(?U)"


def parse_dictionary(lines: DataFrame, line: str = "value", number: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Rules ``(line_no, pattern, value)`` and rejected lines.

    Blank and comment lines are no rules, comments end a line, one token deletes
    its match, three tokens or more are rejected.
    """
    trimmed = T.strip(F.col(line))
    body = F.split(F.split(trimmed, "#", 2).getItem(0), "//", 2).getItem(0)
    tokens = F.filter(F.split(body, r"(?U)\s+"), lambda t: t != "")
    cut = lines.select(F.col(number).alias("line_no"), trimmed.alias("line"), tokens.alias("tokens"))
    cut = cut.where((F.col("line") != "") & ~F.col("line").rlike("^(#|//)") & (F.size("tokens") > 0))
    rules = cut.where(F.size("tokens") <= 2).select(
        "line_no", F.col("tokens").getItem(0).alias("pattern"),
        F.coalesce(F.try_element_at("tokens", F.lit(2)), F.lit("")).alias("value"))
    return rules, cut.where(F.size("tokens") > 2).select("line_no", "line")


def collect_rules(rules: DataFrame) -> list[tuple[int, str, str]]:
    """A dictionary is job configuration: its rules become literals of the plan."""
    return [(r.line_no, r.pattern, r.value) for r in rules.orderBy("line_no").collect()]


def apply_rules(text: Column, rules: list[tuple[int, str, str]]) -> Column:
    """Chain every rule over the text in line order."""
    for _, pattern, value in rules:
        text = F.regexp_replace(text, _UNICODE + pattern, value)
    return text


def replacement_audit(df: DataFrame, key: list[str], text: str, rules: list[tuple[int, str, str]]) -> DataFrame:
    """One row per rule that changed a text: line, text before and after, value."""
    steps = []
    start = F.col(text)
    names = []
    for i, (_, pattern, value) in enumerate(rules):
        df = df.withColumn(f"_t{i}", F.regexp_replace(start, _UNICODE + pattern, value))
        start = F.col(f"_t{i}")
        names.append(f"_t{i}")
    before = [text] + names[:-1]
    for (line, _, value), b, a in zip(rules, before, names):
        steps.append(F.struct(F.lit(line).alias("line_no"), F.col(b).alias("before"),
                              F.col(a).alias("after"), F.lit(value).alias("value")))
    out = df.select(*key, F.inline(F.array(*steps)))
    return out.where("before <> after")


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as that can be told simply; empty if it cannot.

    Groups, classes, alternatives and flags are not looked into.
    """
    if re.search(r"(?<!\\)\||\(\?|\\Q", pattern):
        return ""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 2
            continue
        if c in "\\.^$+*?{[()]}":
            if c in "*?{":
                run = run[:-1]  # what may be missing
            runs.append(run)
            run = ""
            if c == "\\":
                i += 1
            elif c in "[({":
                depth, close = 1, {"[": "]", "(": ")", "{": "}"}[c]
                while depth and i + 1 < len(pattern):
                    i += 1
                    if pattern[i] == "\\":
                        i += 1
                    else:
                        depth += (pattern[i] == c) - (pattern[i] == close)
                if i + 1 < len(pattern) and pattern[i + 1] in "*?{+":
                    i += 1
                    while pattern[i] == "{" and i + 1 < len(pattern) and "}" in pattern[i:]:
                        i = pattern.index("}", i)
        else:
            run += c
        i += 1
    return max([*runs, run], key=len)


def _plain(pattern: str, value: str) -> bool:
    """Whether a rule replaces one literal text by another: no sign of either has a meaning of its own."""
    return bool(pattern) and not re.search(r"[\\^$.|?*+()\[\]{}]", pattern) and not re.search(r"[\\$]", value)


#: Characters of texts that workers hand back at once, or those of one text and its change.
_SENT_CHARS = 1 << 19


def _candidates(rules: list[tuple[int, str, str]]):
    """Function of texts and first rules: the rules of plain texts that change a text, and the rules that may change it next.

    Rules are followed in line order; a plain one is done where it stands, as
    often as its change lets others hit, up to the first that is a pattern and
    may hit. ``changed`` are the numbers of the plain rules that were done,
    ``text`` is the text after them, null if there are none. ``rules`` are the
    numbers of that pattern and of those behind it that may hit.
    """
    plain = [_plain(pattern, value) for _, pattern, value in rules]
    literals = [required_literal(pattern) for _, pattern, _ in rules]
    always = [i for i, literal in enumerate(literals) if not literal]
    reach = max(map(len, literals), default=1) - 1

    def build():
        import ahocorasick

        trie, numbers = ahocorasick.Automaton(), {}
        for i, literal in enumerate(literals):
            if literal:
                numbers.setdefault(literal, []).append(i)
        for literal, same in numbers.items():
            trie.add_word(literal, same)
        if numbers:
            trie.make_automaton()
        return trie

    def hits(trie, text: str) -> set[int]:
        return {i for _, numbers in trie.iter(text) for i in numbers} if text and len(trie) else set()

    def changed_parts(old: str, new: str, pattern: str, value: str) -> Iterator[str]:
        """Parts of a changed text that hold all literals it did not hold before: values, and as much around them as a literal reaches."""
        if old.count(pattern) * (len(value) + 2 * reach) >= len(new):
            yield new
            return
        at, moved = old.find(pattern), 0
        while at >= 0:
            yield new[max(0, at + moved - reach):at + moved + len(value) + reach]
            at, moved = old.find(pattern, at + len(pattern)), moved + len(value) - len(pattern)

    def follow(trie, text: str | None, first: int) -> tuple[list[int], str | None, list[int]]:
        seen = {i for i in {*hits(trie, text), *always} if i >= first} if text is not None else set()
        changed, waiting = [], sorted(seen)
        while waiting and plain[waiting[0]]:
            i = heapq.heappop(waiting)
            _, pattern, value = rules[i]
            new = text.replace(pattern, value)
            if new == text:  # replaced by itself, or changed by a rule before
                continue
            changed.append(i)
            for part in changed_parts(text, new, pattern, value):
                for j in hits(trie, part):
                    if j > i and j not in seen:
                        seen.add(j)
                        heapq.heappush(waiting, j)
            text = new
        return changed, text if changed else None, sorted(waiting)

    @F.arrow_udf("changed array<int>, text string, rules array<int>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = build()
        for texts, begin in batches:
            rows, size = [], 0
            for k in range(len(texts)):
                rows.append(follow(trie, texts[k].as_py(), begin[k].as_py()))
                size += len(rows[-1][1] or "")
                if size >= _SENT_CHARS or k + 1 == len(texts):
                    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32())))]
                    yield pa.StructArray.from_arrays(columns, ["changed", "text", "rules"])
                    rows, size = [], 0

    return find


def _listed(values: list, kind: str) -> Column:
    """One constant array, however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _replacement_rounds(df: DataFrame, text: str, rules: list[tuple[int, str, str]], audit: bool) -> Iterator[DataFrame]:
    """Rounds of all rows that the rules may still change.

    A round does the plain rules of a text and then the patterns that can hit it
    up to the first that changes it; only then its new text is looked at again,
    for the rules behind. The result is that of the chain of all rules, at one
    round per change by a pattern: rows with ``_next``, its first rule, go on
    into the next. For an audit rows have the numbers of the rules that changed
    them, ``_done``, ``text`` as it was before all of these, if there are any,
    and ``_after``, the text after the pattern; no text of a change is kept, as a text may have hundreds.
    """
    find = _candidates(rules)
    patterns, values = _listed([_UNICODE + p for _, p, _ in rules], "string"), _listed([v for *_, v in rules], "string")
    state = df.withColumn("_next", F.lit(0))

    def step(s, i):
        new = F.regexp_replace(s["text"], F.element_at(patterns, i + 1), F.element_at(values, i + 1))
        tried = F.transform(F.array(new), lambda t: F.struct(t.alias("text"), F.when(t != s["text"], i).alias("rule")))[0]
        return F.when(s["rule"].isNotNull(), s).otherwise(tried)

    while True:
        found = state.withColumn("_found", find(F.col(text), F.col("_next")))
        start = F.struct(F.coalesce("_found.text", F.col(text)).alias("text"), F.lit(None).cast("int").alias("rule"))
        done = found.withColumn("_out", F.aggregate("_found.rules", start, step))
        after, rule = F.col("_out.text"), F.col("_out.rule")
        if audit:
            numbers = F.when(rule.isNull(), F.col("_found.changed")).otherwise(F.concat("_found.changed", F.array(rule)))
            columns = {"_done": numbers, text: F.when(F.size(numbers) > 0, F.col(text)), "_after": F.when(rule.isNotNull(), after)}
        else:
            columns = {text: after}
        done = cut_lineage(done.withColumns(columns | {"_next": rule + 1}).drop("_found", "_out"))
        yield done
        state = done.where("_next IS NOT NULL")
        if audit:
            state = state.withColumn(text, F.col("_after")).drop("_done", "_after")
        if state.isEmpty():
            return


def apply_dictionary(df: DataFrame, text: str, rules: list[tuple[int, str, str]]) -> DataFrame:
    """``df`` with all rules applied to ``text`` in line order; for dictionaries of thousands of lines."""
    if not rules:
        return df
    return reduce(DataFrame.unionByName, [done.where("_next IS NULL").select(*df.columns) for done in _replacement_rounds(df, text, rules, False)])


def _texts_of_changes(done: DataFrame, key: list[str], text: str, rules: list[tuple[int, str, str]]) -> DataFrame:
    """Pieces ``(*key, _rules, _texts)`` of what changed in a round of an audit: a text more than rules, the first as it was before them.

    Changes are made again from the rules' numbers, a few at once, so however
    many a text has, a task holds little more than one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-3]
            numbers, before, after = batch.columns[-3:]
            rows, size = [], 0

            def sent():
                taken = batch.select(names).take(pa.array([k for k, *_ in rows], pa.int64()))
                lists = [pa.array([row[1] for row in rows], pa.list_(pa.int32())), pa.array([row[2] for row in rows], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([*taken.columns, *lists], [*names, "_rules", "_texts"])

            for k in range(batch.num_rows):
                steps, last, now = numbers[k].as_py(), after[k].as_py(), before[k].as_py()
                for n, i in enumerate(steps):
                    if not n or not rows:
                        rows.append((k, [], [now]))
                        size += len(now)
                    pattern = last is not None and n + 1 == len(steps)
                    now = last if pattern else now.replace(rules[i][1], rules[i][2])
                    rows[-1][1].append(i)
                    rows[-1][2].append(now)
                    size += len(now)
                    if size >= _SENT_CHARS:
                        yield sent()
                        rows, size = [], 0
            if rows:
                yield sent()

    changed = done.where(F.size("_done") > 0).select(*key, "_done", text, "_after")
    fields = [changed.schema[name] for name in changed.columns[:-3]]
    return changed.mapInArrow(run, StructType(fields).add("_rules", ArrayType(IntegerType())).add("_texts", ArrayType(StringType())))


def audit_dictionary(df: DataFrame, key: list[str], text: str, rules: list[tuple[int, str, str]]) -> DataFrame:
    """:func:`replacement_audit` for dictionaries of thousands of lines: a text is kept once per round, not once per change or rule.

    The key passes through Arrow, which takes no intervals of months and no calendar intervals.
    """
    lines, values = _listed([n for n, *_ in rules], "bigint"), _listed([v for *_, v in rules], "string")
    changes = F.transform("_rules", lambda r, i: F.struct(r.alias("rule"), F.get("_texts", i).alias("before"), F.get("_texts", i + 1).alias("after")))
    rows = [_texts_of_changes(done, key, text, rules).select(*key, F.inline(changes)).select(
                *key, F.element_at(lines, F.col("rule") + 1).alias("line_no"), "before", "after", F.element_at(values, F.col("rule") + 1).alias("value"))
            for done in _replacement_rounds(df.select(*key, text), text, rules, True)]
    return reduce(DataFrame.unionByName, rows)


# --- prompts and replies ----------------------------------------------------


def numbered_prompt(df: DataFrame, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``[1] first\\n[2] second`` per group, the texts in the given order.

    The prompt of a group is one value, so a group has to fit one request.
    """
    item = F.struct(*order, F.col(text).alias("_text"))
    grouped = df.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    rows = F.transform("_items", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["_text"]))
    return grouped.select(*group, F.size("_items").alias("expected"), F.array_join(rows, "\n").alias("texts"))


def prompts_by_budget(df: DataFrame, group: list[str], order: list[str], budget: int, text: str = "text") -> DataFrame:
    """Numbered prompts of at most ``budget`` bytes: ``prompt``, its ``numbers`` and ``texts``; several per group.

    Numbers go on through all prompts of a group, so replies need no other key.
    A line of more than half the budget has a prompt of its own, the others are
    cut where their running size passes half the budget again: no text is lost
    or cut. Only a single text beyond the budget makes a prompt beyond it.
    """
    numbered = ranked(df.select(*group, *order, F.col(text).alias("_text")), group, [*order, "_text"], "_n")
    line = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.coalesce("_text", F.lit("")))
    half = budget // 2
    sized = numbered.select(*group, "_n", line.alias("_line")).withColumn("_size", F.octet_length("_line") + 1).withColumn("_large", F.col("_size") > half)
    summed = ranked(sized.withColumn("_part_of", F.when(F.col("_large"), 0).otherwise(F.col("_size")).cast("bigint")), group, ["_n"], "_again", "_part_of", "_upto")
    piece = F.when(F.col("_large"), F.struct(F.lit(True).alias("large"), F.col("_n").alias("at"))).otherwise(
        F.struct(F.lit(False).alias("large"), F.floor((F.col("_upto") - F.col("_size")) / F.lit(half)).cast("bigint").alias("at")))
    packed = summed.groupBy(*group, piece.alias("_piece")).agg(F.sort_array(F.collect_list(F.struct("_n", "_line"))).alias("_items"))
    return packed.select(*group, F.col("_items._n")[0].alias("prompt"), F.size("_items").alias("expected"), F.col("_items._n").alias("numbers"),
                         F.array_join(F.col("_items._line"), "\n").alias("texts"))


_REPLY = r"^\s*(?:\[(\d+)\]|(\d+)[\.\):：、])\s*(.*)\s*$"


def parse_numbered_reply(df: DataFrame, key: list[str], content: str = "content", expected: str = "expected", numbers: str | None = None) -> DataFrame:
    """Replies to ``(key, number, text, error)``; errors are rows of their own.

    A reply should have the numbers 1 to ``expected``, or those that ``numbers`` lists.
    """
    lines = df.select(*key, numbers or expected, F.posexplode(F.split(F.col(content), "\r?\n")).alias("line_no", "line"))
    lines = lines.where(T.strip(F.col("line")) != "")
    number = F.concat(F.regexp_extract("line", _REPLY, 1), F.regexp_extract("line", _REPLY, 2))
    lines = lines.withColumns({
        "number": F.when(number != "", number.cast("bigint")), "text": F.regexp_extract("line", _REPLY, 3)})
    turn = F.row_number().over(Window.partitionBy(*key, "number").orderBy("line_no"))
    error = (
        F.when(F.col("number").isNull(), F.lit("unnumbered"))
        .when(~F.array_contains(numbers, F.col("number")) if numbers else (F.col("number") < 1) | (F.col("number") > F.col(expected)), F.lit("out of range"))
        .when(turn > 1, F.lit("duplicate"))
    )
    parsed = lines.withColumn("error", error)
    want = df.select(*key, F.explode(numbers if numbers else F.sequence(F.lit(1).cast("bigint"), F.col(expected).cast("bigint"))).alias("number"))
    missing = want.join(parsed.where("error IS NULL").select(*key, "number"), [*key, "number"], "left_anti")
    return parsed.select(*key, "number", "text", "error").unionByName(
        missing.select(*key, "number", F.lit(None).cast("string").alias("text"), F.lit("missing").alias("error")))


# Endpoints of the provider presets.
PRESETS = {
    "OpenAI": "https://api.openai.com/v1",
    "DeepSeek": "https://api.deepseek.com/v1",
    "OpenRouter": "https://openrouter.ai/api/v1",
    "SiliconFlow": "https://api.siliconflow.cn/v1",
    "DashScope": "https://dashscope.aliyuncs.com/compatible-mode/v1",
    "Moonshot": "https://api.moonshot.cn/v1",
    "Zhipu": "https://open.bigmodel.cn/api/paas/v4",
}


def resolve_endpoint(preset: Column, base_url: Column) -> Column:
    """Own address unless blank, else the preset's, ending in /chat/completions."""
    own = F.nullif(T.strip(F.coalesce(base_url, F.lit(""))), F.lit(""))
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in PRESETS.items() for v in kv]), preset)
    return F.concat(F.rtrim(F.coalesce(own, known), F.lit("/")), F.lit("/chat/completions"))


# --- routes -----------------------------------------------------------------


def last_targets(routes: DataFrame, setting: list[str]) -> DataFrame:
    return routes.groupBy(*setting, "src_lang").agg(F.max_by("target", "step").alias("next"))


def validate_routes(routes: DataFrame, setting: list[str]) -> DataFrame:
    """One row per setting: ``problem`` is null when its route table is usable.

    A default row has to exist, no step list may be empty, and following the
    last target of every language must end.  Each round doubles the number of
    hops looked ahead, for all settings at once.
    """
    facts = routes.groupBy(*setting).agg(
        F.count_if(F.col("src_lang").isNull()).alias("_defaults"), F.count_if(F.col("target").isNull()).alias("_empty"),
        F.count_distinct("src_lang").alias("_keys"))
    hop = last_targets(routes.where("src_lang IS NOT NULL AND target IS NOT NULL"), setting)
    known = hop.select(*setting, F.col("src_lang").alias("next"))
    hop = cut_lineage(hop.join(known, [*setting, "next"], "left_semi"))
    longest = facts.agg(F.max("_keys")).first()[0] or 0
    reach = 1
    while reach <= longest:
        ahead = hop.select(*setting, F.col("src_lang").alias("next"), F.col("next").alias("_then"))
        hop = cut_lineage(hop.join(ahead, [*setting, "next"]).select(*setting, "src_lang", F.col("_then").alias("next")))
        reach *= 2
    loops = hop.select(*setting).distinct().withColumn("_loop", F.lit(True))
    return facts.join(loops, setting, "left").select(
        *setting,
        F.when(F.col("_defaults") == 0, F.lit("no default"))
        .when(F.col("_empty") > 0, F.lit("empty array"))
        .when(F.col("_loop"), F.lit("loop detected")).alias("problem"))


def with_route(df: DataFrame, routes: DataFrame, lang: str = "language") -> DataFrame:
    """Add ``steps``: the language's own step list, else the default's."""
    step = F.struct("step", "translator", "target")
    lists = routes.groupBy("src_lang").agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    own = broadcast_if_few(lists.where("src_lang IS NOT NULL"))
    default = lists.where("src_lang IS NULL").select("_steps").first()
    base = default["_steps"] if default else []
    fallback = F.array(*[
        F.struct(F.lit(s["step"]).cast("int").alias("step"), F.lit(s["translator"]).alias("translator"),
                 F.lit(s["target"]).alias("target")) for s in base])
    joined = df.join(own, df[lang] == own["src_lang"], "left").drop("src_lang")
    return joined.withColumn("steps", F.coalesce("_steps", fallback)).drop("_steps")


def joined_language(df: DataFrame, group: list[str], order: list[str], profiles: DataFrame, text: str = "text") -> DataFrame:
    """Language of all texts of a group together.

    Scores add up over the texts, so the group is never put into one string.
    """
    script = df.groupBy(*group).agg(F.max(F.struct(
        F.when(L.script_language(F.col(text)).isNull(), 0).otherwise(1).alias("has"),
        L.script_language(F.col(text)).alias("s"))).alias("_script"))
    scores = L.best_language(df, profiles, group, text)
    return script.join(scores, group, "left").select(
        *group, F.coalesce("_script.s", "best.lang").alias("language"))


def insert_translation(translations: Column, name: Column, text: Column) -> Column:
    """Put a translation into the map; the same language is overwritten."""
    key = F.coalesce(name, F.lit("unknown"))
    base = F.map_filter(
        F.coalesce(translations, F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))),
        lambda k, v: (k != key) & (k != "last_trans"))
    return F.map_concat(base, F.map_from_arrays(F.array(key, F.lit("last_trans")), F.array(text, key)))


def translate_distinct(df: DataFrame, text: str, translator, schema_field: str = "translated") -> DataFrame:
    """Translate each distinct text once with a batch function, then join back.

    ``translator(list[str]) -> list[str]`` gets the texts of one Arrow batch.
    """
    distinct = df.select(F.col(text).alias("_src")).distinct()

    def run(batches):
        for batch in batches:
            batch[schema_field] = translator(batch["_src"].tolist())
            yield batch

    done = distinct.mapInPandas(run, f"_src string, {schema_field} string")
    return df.join(done, df[text] == done["_src"], "left").drop("_src")


def glossary_translate(text: Column, glossary: dict[str, str]) -> Column:
    """Table-driven translation: whole words are replaced, longest entry first."""
    for word in sorted(glossary, key=lambda w: (-len(w), w)):
        text = F.regexp_replace(text, _UNICODE + rf"\b{word}\b", glossary[word])
    return text


def with_joined_language(blocks: DataFrame, profiles: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Blocks with the ``language`` of all texts of their group together, in place of their own."""
    found = joined_language(blocks, group, order, profiles)
    return blocks.drop("language").join(found, group, "left")


def _translated(df: DataFrame, name: str, translator, active: Column) -> DataFrame:
    """``_current`` by ``translator(texts, source, target)`` where the step names it; each distinct text once per pair of languages."""
    df = cut_lineage(df)  # read twice below: the steps before must not run twice
    source, target = F.col("language"), F.col("_step.target")
    use = F.coalesce(active & (F.col("_step.translator") == name), F.lit(False))
    todo = df.where(use).select(F.col("_current").alias("_src"), source.alias("_from"), target.alias("_to")).distinct()

    def run(batches):
        for batch in batches:
            for (a, b), part in batch.groupby(["_from", "_to"], dropna=False):
                yield part.assign(_out=translator(part["_src"].tolist(), a if isinstance(a, str) else None, b))

    done = todo.mapInPandas(run, "_src string, _from string, _to string, _out string")
    same = use & F.col("_current").eqNullSafe(F.col("_src")) & source.eqNullSafe(F.col("_from")) & (target == F.col("_to"))
    return df.join(done, same, "left").withColumn("_current", F.coalesce("_out", "_current")).drop("_src", "_from", "_to", "_out")


def _step_at(k: int) -> Column:
    return F.get(F.filter("steps", lambda s: s["step"] == k), F.lit(0))


def translate_blocks(
    blocks: DataFrame, routes: DataFrame, glossaries: dict[tuple[str, str], dict[str, str]],
    pre_rules=(), post_rules=(), translators: dict | None = None,
) -> DataFrame:
    """Pre-dictionary, translatable subset, route steps, map entries, post-dictionary.

    A step is done by the function that ``translators`` has under its name,
    ``fn(texts, source, target) -> texts``, or by a glossary of the plan.

    Blocks carry ``text, language, skip_translate``.  The number of steps is the
    longest list of the (small) route table; step k reads the output of step k-1.
    """
    blocks = blocks.withColumn("text", apply_rules(F.col("text"), list(pre_rules)))
    blocks = with_route(blocks, routes)
    depth = max((r.step for r in routes.select("step").distinct().collect()), default=-1) + 1
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    df = blocks.withColumns({"translations": empty, "_current": F.col("text")})
    for k in range(depth):
        df = df.withColumn("_step", _step_at(k))
        active = F.col("_step").isNotNull() & ~F.col("skip_translate")
        out = F.col("_current")
        for (name, target), words in glossaries.items():
            use = (F.col("_step.translator") == name) & (F.col("_step.target") == target)
            out = F.when(use, glossary_translate(F.col("_current"), words)).otherwise(out)
        df = df.withColumn("_current", F.when(active, out).otherwise(F.col("_current")))
        for name, translator in (translators or {}).items():
            df = _translated(df, name, translator, active)
        name = L.language_name(F.col("_step.target"))
        df = df.withColumn("translations", F.when(
            active, insert_translation(F.col("translations"), name, F.col("_current"))).otherwise(F.col("translations")))
    post = F.transform_values("translations", lambda k, v: F.when(k == "last_trans", v).otherwise(apply_rules(v, list(post_rules))))
    return df.withColumn("translations", post).drop("_current", "_step", "steps")

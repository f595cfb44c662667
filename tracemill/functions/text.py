"""Text functions on columns: extraction of answers, rewriting of model output, prompts, steps.

All are built-in expressions. Null in, null out, unless a function says otherwise. Patterns
carry the flags ``d`` (only a line feed ends a line) and ``u`` (Unicode case folding).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), rf"(?U)^{BLANKS}+|{BLANKS}+$(?!\n)", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


def strip_right(c: Column | str, chars: str) -> Column:
    """Without any of ``chars`` at the end."""
    inside = "".join("\\" + x for x in chars)
    return F.regexp_replace(col(c), f"[{inside}]+\\z", "")


def lit(c: Column | str, find: str, put: str) -> Column:
    """Every occurrence of a plain string replaced."""
    return F.replace(col(c), F.lit(find), F.lit(put))


def last_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the last match, null without one."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.lit(-1))


def part(c: Column, pattern: str, index: int) -> Column:
    """Part ``index`` (negative from the end) of a split by a pattern."""
    return F.try_element_at(F.split(c, pattern, -1), F.lit(index))


def with_period(c: Column) -> Column:
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


# Answers -------------------------------------------------------------------------------------


def extract_template(c: Column | str, phrase: str = "answer") -> Column:
    """What the last "The <phrase> is" of the text says, to the last period of its line or its end."""
    return strip_chars(strip(last_match(c, rf"(?iud)The {phrase} is(.*)(?:\.|$)")), ".")


def extract_sentence(c: Column | str, phrase: str = "The answer is") -> Column:
    """Like :func:`extract_template` on the text with a period put at its end."""
    return strip_chars(strip(last_match(with_period(col(c)), rf"(?iud){phrase}(.*)(?:\.|$)")), ".")


def extract_answer(c: Column | str, phrase: str = "The answer is") -> Column:
    """The answer of a response to a benchmark: after thinking, or by the first of four phrases,
    else the last line. Never null for a text."""
    text = with_period(col(c))
    after = F.substring_index(text, "</think>", -1)
    thought = F.substring_index(part(after, "\nThe answer is", 1), "Answer: ", -1)
    found = F.coalesce(*[
        last_match(text, f"(?iud){p}([^\\n]*)")
        for p in (phrase, "The correct answer is", r"Final Answer[:\s]*", "Final answer is")
    ])
    for chars in (":", " ", ".", "*"):
        found = strip_chars(found, chars)
    last_line = F.substring_index(text, "\n", -1)
    thinking = text.contains("<think>") & text.contains("</think>")
    return F.when(thinking, thought).otherwise(F.coalesce(found, last_line))


def extract_tagged(c: Column | str) -> Column:
    """Inside of the last ``<answer>`` element."""
    return strip(last_match(c, r"(?s)<answer.*?>(.*?)</answer>"))


def first_char_of_answer(c: Column | str, phrase: str = "answer") -> Column:
    return F.substring(extract_template(c, phrase), 1, 1)


def fenced_blocks(c: Column | str) -> Column:
    """Insides of all ``` blocks, without line feeds at their ends."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s)```(.*?)```"), F.lit(1)), lambda x: F.btrim(x, F.lit("\n")))


def cut_calculation(c: Column | str) -> Column:
    """The answer before any "However", then before any bracket."""
    return F.substring_index(F.substring_index(col(c), "However", 1), "(", 1)


def answer_end(c: Column | str, phrase: str = "The answer is") -> Column:
    """Index behind the ".\\n\\n" that follows the phrase; -1 without both."""
    x = col(c)
    at = F.locate(phrase, x)
    end = F.expr("0") + F.instr(F.substring(x, at, F.char_length(x)), ".\n\n")
    return F.when((at > 0) & (end > 0), at + end + 1).otherwise(-1)


def cut_second_answer(c: Column | str, phrase: str = "the answer is") -> Column:
    """The text before the second occurrence of the phrase in any case."""
    x, low = col(c), F.lower(col(c))
    first = F.instr(low, phrase)
    rest = F.substring(low, first + len(phrase), F.char_length(low))
    second = F.instr(rest, phrase)
    return F.when((first > 0) & (second > 0), F.substring(x, F.lit(1), first + len(phrase) + second - 2)).otherwise(x)


def cut_trace(c: Column | str, phrase: str = "The answer is ") -> Column:
    """The text to one character behind the phrase, and a period; without the phrase as many characters as it has are kept."""
    x = col(c)
    at = F.instr(x, phrase) - 1
    return F.concat(F.substring(x, F.lit(1), at + len(phrase) + 1), F.lit("."))


# Normalisation -------------------------------------------------------------------------------


def plain_answer(c: Column | str) -> Column:
    """First clause without punctuation and articles, single spaces."""
    x = F.substring_index(F.substring_index(F.substring_index(col(c), "\n", 1), ".", 1), ",", 1)
    x = F.regexp_replace(x, r"(?U)[^\w\s]", "")
    x = F.regexp_replace(x, r"(?iU)\b(a|an|the)\b", "")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def thousands(c: Column | str) -> Column:
    """Commas between groups of three digits of the integer part."""
    x = col(c).cast("string")
    whole, rest = F.regexp_extract(x, r"^([^.]*)(.*)$", 1), F.regexp_extract(x, r"^([^.]*)(.*)$", 2)
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ","), rest)


def trim_zeros(c: Column | str) -> Column:
    """A number without useless zeros at its end; other texts as they are."""
    x = col(c)
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    number = F.regexp_replace(number, r"^(-?)\.", "$10.")
    return F.when(x.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), number).otherwise(x)


def latex(c: Column | str) -> Column:
    """LaTeX in one spelling: spaces, units, brace-less fractions and roots, simple quotients."""
    x = lit(lit(lit(c, "\n", ""), "\\!", ""), "\\\\", "\\")
    for find, put in (("minus", "-"), ("plus", "+"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\pi", "π")):
        x = lit(x, find, put)
    x = lit(strip_chars(x, "$"), "\\$", "")
    x = drop_units(x)
    x = lit(lit(lit(x, "\\%", ""), " .", " 0."), "{.", "{0.")
    x = bound(x, lambda v: F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v))
    x = bound(F.split(x, "=", -1), lambda v: F.when((F.size(v) == 2) & (F.char_length(v[0]) <= 2), v[1]).otherwise(F.array_join(v, "=")))
    x = F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")
    x = lit(x, " ", "")
    x = braced_fractions(x)
    return F.regexp_replace(x, r"^(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))$", r"\\frac{$1}{$2}")


def braced_fractions(c: Column | str) -> Column:
    """Braces around one-letter numerators and denominators; a fraction cut off stays as it is."""
    fixed = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    return bound(col(c), lambda x: F.when(x.rlike(r"\\frac[^{]?($|\\frac)") & ~x.rlike(r"\\frac$"), x).otherwise(fixed(x)))


def drop_units(c: Column | str) -> Column:
    return F.substring_index(col(c), "\\text{ ", 1)


def clean_units(c: Column | str) -> Column:
    """A number's text without currency and degree signs, percent as a quotient, and pi as 3.14: a factor behind a
    digit, left alone behind a closing brace."""
    x = F.regexp_replace(lit(c, "\\pi", "π"), r"(?<![\d}])\\?π", "3.14")
    x = F.regexp_replace(x, r"(?<=\d)\\?π", "*3.14")
    return F.regexp_replace(F.regexp_replace(lit(x, "%", "/100"), r"[$¥]", ""), "°C?| C", "")


def options(c: Column | str) -> Column:
    """The choices (A) to (E) behind "Answer Choices:", as an array."""
    x = F.substring_index(strip(F.substring_index(col(c), "Answer Choices:", -1)), "Let's", 1)
    parts = F.split(x, r"\([A-E]\)", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)


def add_tag(c: Column | str, kind: str) -> Column:
    return F.concat(col(c), F.lit(_tag(kind)))


def remove_tag(c: Column | str, kind: str) -> Column:
    return lit(c, _tag(kind) or " ", "")


def _tag(kind: str) -> str:
    return " Let's write a program." if kind == "pot_prompt" else f" {kind}" if kind else ""


# Steps ---------------------------------------------------------------------------------------


def split_steps(c: Column | str) -> Column:
    """Pieces between blank lines before "Step", each beginning with "Step" again."""
    return F.transform(F.split(col(c), "\n\nStep", -1), lambda x: F.when(x.startswith("Step"), x).otherwise(F.concat(F.lit("Step"), x)))


def prefix_steps(steps: Column | str) -> Column:
    """Running texts: the first i steps and a blank line, for each i."""
    s = col(steps)
    return F.transform(s, lambda _, i: F.concat(F.array_join(F.slice(s, F.lit(1), i + 1), "\n\n"), F.lit("\n\n")))


def finish_steps(c: Column | str) -> Column:
    """A finish text cut at every "Step"; numbers and colons are dropped from later pieces."""
    parts = F.split(col(c), "Step", -1)
    return F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.substring(x, F.lit(5), F.char_length(x))))


def step_text(c: Column | str) -> Column:
    """Stripped, with exactly one period at the end."""
    return F.concat(strip_right(strip(c), "."), F.lit("."))


def path_text(chain: Column | str) -> Column:
    """"Step i: text" lines from the root, joined by blank lines."""
    lines = F.transform(col(chain), lambda x, i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "), x))
    return F.btrim(F.array_join(lines, "\n\n"), F.lit("\n"))


#: Texts that end a reflection, and what a plan begins with.
REFLECTION_ENDS = ("\n\n<problem>", "\n\n<steps>", "\n\nStep", "\n\n<step>")
PLAN_LEAD = "Decompose the problem into smaller, solvable sub-problems: "


def reflection(c: Column | str, ends: tuple[str, ...] = REFLECTION_ENDS) -> Column:
    """A reflection to the first of the ends, led in by "But wait, "."""
    x = col(c)
    for end in ends:
        x = F.substring_index(x, end, 1)
    return F.concat(F.lit("But wait, "), x)


def plans(c: Column | str, lead: str = PLAN_LEAD) -> Column:
    """The plans of a decomposition, each led in: paragraphs that begin with "1.", where one that holds
    "Plan n:" begins at the first digit after the n's first."""
    body = lambda p: F.when(p.rlike(r"Plan \d+:"), F.regexp_extract(p, r"(?s)Plan \d(?=\d*:)\D*(\d.*)$", 1)).otherwise(p)
    bodies = F.filter(F.transform(F.split(col(c), "\n\n", -1), body), lambda p: p.startswith("1."))
    return F.transform(bodies, lambda p: F.concat(F.lit(lead), p))


# Rewriting of generations --------------------------------------------------------------------


def drop_chatter(c: Column | str) -> Column:
    """Drop a leading "Here is" paragraph or one that speaks of itself; a text with "I hope" loses
    its last paragraph instead."""
    x = col(c)
    paragraphs = F.split(x, "\n\n", -1)
    n = F.size(paragraphs)
    tail = F.array_join(F.slice(paragraphs, F.lit(2), F.greatest(n - 1, F.lit(0))), "\n\n")
    head = F.array_join(F.slice(paragraphs, F.lit(1), F.greatest(n - 1, F.lit(0))), "\n\n")
    leads = x.startswith("Here is") | x.startswith("Based on") | x.startswith("Here's")
    speaks = x.contains("I'd like") | x.contains("I'd be") | x.contains("I'm") | x.contains("I would")
    return F.when(x.contains("I hope"), head).when(leads | speaks, tail).otherwise(x)


def drop_chatter_all(texts: Column | str) -> Column:
    return F.transform(col(texts), drop_chatter)


def is_plain_generation(c: Column | str) -> Column:
    """Whether a generated question has none of the words of a remark about it."""
    low = F.lower(col(c))
    return ~(low.contains("to create") | low.contains("version") | low.contains("here's"))


def drop_markers(c: Column | str) -> Column:
    """What stands behind the "#Rewritten Prompt#" or "#Created Prompt#" mark."""
    x = col(c)
    for mark in ("#Rewritten Prompt#", "#Created Prompt#"):
        x = F.substring_index(x, mark, -1)
    return strip(F.btrim(strip(x), F.lit(":")))


def first_acceptable(outputs: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """The first output of each group that is a plain generation; groups without one are left out."""
    best = F.min_by(F.struct(*outputs.columns), order).alias("_best")
    return outputs.filter(is_plain_generation(text)).groupBy(*by).agg(best).select("_best.*")


def standard_output(outputs: DataFrame, by: list[str], order: str, words: list[str], text: str = "text", all_words: bool = False) -> DataFrame:
    """The last output of each group that has none of the words (``all_words``: that has every one)."""
    found = [col(text).contains(w) for w in words]
    fits = F.lit(True)
    for f in found:
        fits = fits & (f if all_words else ~f)
    return outputs.filter(fits).groupBy(*by).agg(F.max_by(F.struct(*outputs.columns), order).alias("_best")).select("_best.*")


def fill(template: str, **values: Column) -> Column:
    """A prompt template with its {names} filled in."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(col(values[name]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def append_answer(output: Column | str, answer: Column | str, phrase: str = "The answer is ") -> Column:
    """The output with the answer sentence put behind it."""
    x = col(output)
    return F.concat(x, F.when(x.endswith("."), F.lit(" ")).otherwise(F.lit(". ")), F.lit(phrase), col(answer), F.lit("."))


#: What may stand around an answer and is no part of it: white space, braces, colons, periods and quotes.
AROUND_ANSWER = r"""[\s{}:.\"']+"""


def teacher_answer(response: Column | str) -> Column:
    """The bare answer that a teacher's response gives: what its last "The answer is" says, with any word before "answer" (correct,
    final), behind any further "answer" in the sentence, without what stands around it. Null without such a sentence."""
    said = F.substring_index(extract_template(response, r"(?:[a-z]+ )?answer"), "answer", -1)
    return F.regexp_replace(said, rf"^{AROUND_ANSWER}|{AROUND_ANSWER}\z", "")


def answers_agree(said: Column, idx: Column, gold: Column) -> Column:
    """Whether an answer is the gold letter, alone or in front of its text, or a longer text that has all words of the
    gold one or is part of it."""
    low, gold_low = F.lower(said), F.lower(gold)
    letter = F.substring(said, 1, 1) == idx
    has_all = F.size(F.array_except(F.split(gold_low, " ", -1), F.split(low, " ", -1))) == 0
    return F.when(F.char_length(said) == 1, letter).otherwise((letter & said.rlike(r"^[A-D]\.\s")) | has_all | gold_low.contains(low))


def accept_response(response: Column | str, answer_idx: Column | str, answer: Column | str) -> Column:
    """A teacher's response whose answer agrees with the gold one, its last paragraph rewritten to
    "The answer is X."; null if it does not agree."""
    text, idx = strip(response), col(answer_idx)
    paragraphs = F.split(text, "\n\n", -1)
    kept = F.array_join(F.slice(paragraphs, F.lit(1), F.size(paragraphs) - 1), "\n\n")
    return F.when(answers_agree(teacher_answer(text), idx, col(answer)), F.concat(kept, F.lit("\n\nThe answer is "), idx, F.lit(".")))


# Prompts and names ---------------------------------------------------------------------------


def chat_prompt(user: Column | str, system: Column | str | None = None) -> Column:
    """Messages (role, content) of one question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), col(c).alias("content"))
    turns = [message("user", user)] if system is None else [message("system", system), message("user", user)]
    return F.array(*turns)


def render_chat(messages: Column | str, start: str = "<|{role}|>\n", end: str = "\n") -> Column:
    before, after = start.split("{role}")
    return F.array_join(F.transform(col(messages), lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(end))), "")


def few_shot(question: Column | str, examples: list[tuple[str, str]]) -> Column:
    """Worked examples in front of the question."""
    shown = "".join(f"Problem: {q}\n\nResponse: {r}\n\n" for q, r in examples)
    return F.concat(F.lit(shown + "Problem: "), col(question), F.lit("\n\nResponse: "))


def by_name(key: Column | str, values: dict[str, str], default: str = "") -> Column:
    """A value by the name of a data set."""
    if not values:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(key)), F.lit(default))


#: What the prompt of a data set ends with.
_SENTENCE = "\n\nPlease format the final answer at the end of the response as: The answer is {answer}."
_LETTER = "\n\nPlease answer with option letter directly, do not output other infomation."
_CHINESE = "\n\n请在回答的最后用以下格式回答：答案为{answer}。"
TASK_SUFFIXES = {
    "apps": "\n\nPlease use python language to answer this problem. You should process stdin and stdout with input() and print():",
    "svamp_prompt_cot": _SENTENCE,
    "bbh_prompt_cot": _SENTENCE,
    "math_prompt_cot": _SENTENCE,
    "mmedbench_en_prompt_cot": _LETTER,
    "mmlu_prompt_cot": _LETTER,
    "logiqa_en_prompt_cot": "\n\nPlease think step by step and give your answer in the end.",
    "commonsense_qa_prompt_cot": "\n\nLet's think step by step. Please format the final answer at the end of the response as: The answer is {answer}.",
    "svamp_100_prompt_cot": _SENTENCE,
    "gsm8k": _SENTENCE,
    "mmedbench_en_cot": _SENTENCE,
    "mmedbench_zh_cot": _CHINESE,
    "PLE_Pharmacy_cot": _CHINESE,
    "PLE_TCM_cot": _CHINESE,
    "math": "\n\nPlease format the final answer at the end of the response as:  The answer is {answer}.",
    "math_500": "\n\nPlease format the final answer at the end of the response as:  The answer is {answer}.",
    "winogrande": _LETTER,
}


def task_suffix(dataset: Column | str) -> Column:
    return by_name(dataset, TASK_SUFFIXES)


def dataset_of(path: Column | str, known: list[str]) -> Column:
    """The last part of a path that names a known data set, without ".jsonl"."""
    parts = F.transform(F.split(col(path), "/"), lambda p: lit(p, ".jsonl", ""))
    return F.try_element_at(F.filter(parts, lambda p: p.isin(known)), F.lit(-1))


def model_of(path: Column | str) -> Column:
    """The last part of a path; a checkpoint's comes with its parent."""
    parts = F.split(col(path), "/")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last.startswith("checkpoint"), F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("-"), last)).otherwise(last)


def token_len(c: Column | str) -> Column:
    """Number of words, the stand-in for a tokenizer's length."""
    x = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))

"""Correctness metrics as columns: 1 or 0, null where the input is null.

Where the plain rule would raise an error (no match to index, empty answer) the metric is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import col

QUOTES = ("'", '"')


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def unquote(c: Column) -> Column:
    for q in QUOTES:
        c = T.lit(c, q, "")
    return c


# Shared rules --------------------------------------------------------------------------------


def choice_or_substring(gold: Column | str, said: Column | str, gold_text: Column | None = None) -> Column:
    """A one-letter gold answer by its letter (or its text, when given), a longer one by substring."""
    g, p = col(gold), col(said)
    letter = F.upper(unquote(p))
    by_letter = F.substring(letter, 1, 1) == g
    if gold_text is not None:
        either = letter.contains(g) | F.lower(unquote(p)).contains(F.lower(gold_text))
        by_letter = F.when(gold_text.isNull(), by_letter).otherwise(either)
    short = (letter != "") & by_letter
    return F.when(p.isNotNull(), flag(F.when(F.char_length(g) == 1, short).otherwise(F.lower(p).contains(F.lower(g)))))


def is_correct(gold: Column | str, said: Column | str) -> Column:
    """A tree node's answer: first character for a one-letter gold, else substring."""
    g, p = col(gold), col(said)
    bare = F.btrim(p, F.lit("' \"*"))
    return flag(F.when(F.char_length(g) == 1, F.substring(bare, 1, 1) == g).otherwise(F.lower(p).contains(F.lower(g))))


def node_value(gold: Column | str, step: Column | str) -> Column:
    said = T.extract_template(step)
    return F.when(said.isNull(), 0).otherwise(is_correct(gold, said))


def pass_at_k(n: Column | str, c: Column | str, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product; 0 when k > n."""
    n_, c_ = col(n).cast("double"), col(c).cast("double")
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (n_ - c_ - i) / F.nullif(n_ - i, F.lit(0.0))
    return F.when(n_ < k, 0.0).when(n_ - c_ < k, 1.0).otherwise(F.lit(1.0) - miss)


# Benchmark metrics ---------------------------------------------------------------------------


def multiple_choice(text: Column | str, gold: Column | str, gold_text: Column | None = None, last_line: bool = False) -> Column:
    x = T.with_period(col(text))
    if last_line:
        x = F.substring_index(x, "\n", -1)
    return choice_or_substring(gold, T.extract_answer(x), gold_text)


def diagnosis(text: Column | str) -> Column:
    """What "The diagnosis result is" says on the first line, else the extracted answer."""
    x = T.with_period(col(text))
    said = T.strip_chars(T.strip(F.substring_index(F.substring_index(x, "\n", 1), "The diagnosis result is ", -1)), ".")
    return F.btrim(F.when(x.contains("The diagnosis result"), said).otherwise(T.extract_answer(x)), F.lit("`"))


def medical_text(text: Column | str, gold: Column | str) -> Column:
    return choice_or_substring(gold, diagnosis(text))


def candidate_answers(texts: Column | str) -> Column:
    """Answers of candidates: extracted where the phrase stands, else as they are."""
    return F.transform(col(texts), lambda x: F.when(F.lower(x).contains("the answer is"), T.extract_answer(x)).otherwise(x))


def candidate_correct(texts: Column | str, gold: Column | str) -> Column:
    g = col(gold)
    return F.transform(candidate_answers(texts), lambda x: F.coalesce(choice_or_substring(g, x), F.lit(0)))


def pass_at(texts: Column | str, gold: Column | str, ks: tuple[int, ...] = (1, 2)) -> Column:
    hits = candidate_correct(texts, gold)
    n, c = F.size(hits), F.aggregate(hits, F.lit(0), lambda a, x: a + x)
    return F.when(n > 0, F.array(*[pass_at_k(n, c, k) for k in ks])).otherwise(F.array().cast("array<double>"))


def mutual_substring(text: Column | str, gold: Column | str) -> Column:
    """Answers that contain each other, in any case; an empty answer is in every gold one.

    Where this gives 0 a judge may be asked: see :func:`judged`."""
    p, g = F.lower(diagnosis(text)), F.lower(col(gold))
    return flag(p.contains(g) | g.contains(p))


def judged(metric: Column, verdict: Column | str) -> Column:
    """A missed metric replaced by a judge's verdict, which holds "1" when it agrees."""
    return F.when(metric == 1, 1).otherwise(flag(F.coalesce(col(verdict), F.lit("")).contains("1")))


# Other metrics -------------------------------------------------------------------------------


def equal(text: Column | str, gold: Column | str) -> Column:
    return flag(col(text) == col(gold))


def equal_without_period(text: Column | str, gold: Column | str) -> Column:
    return flag(F.regexp_replace(col(text), r"\.\z", "") == col(gold))


def equal_or_extracted(text: Column | str, gold: Column | str) -> Column:
    x, g = col(text), col(gold)
    return flag(F.when(F.char_length(x) == 1, x == g).otherwise(F.coalesce(T.extract_sentence(x).contains(g), F.lit(False))))


def _raw_or_extracted(text: Column | str) -> Column:
    x = T.with_period(col(text))
    return F.when(x.contains("The answer is "), T.extract_sentence(x)).otherwise(x)


def medical_substring(text: Column | str, gold: Column | str) -> Column:
    p, g = _raw_or_extracted(text), col(gold)
    return flag(F.coalesce(F.when(F.char_length(g) == 1, unquote(p).contains(g)).otherwise(F.lower(p).contains(F.lower(g))), F.lit(False)))


def any_of(text: Column | str, golds: Column | str) -> Column:
    p = _raw_or_extracted(text)
    return flag(F.coalesce(F.exists(col(golds), lambda g: p.contains(g)), F.lit(False)))


def first_letter(text: Column | str, gold: Column | str) -> Column:
    return flag(F.regexp_extract(col(text), "[A-E]", 0) == col(gold))


def letter_with_period(text: Column | str, gold: Column | str, prefix: str = "the answer is") -> Column:
    said = F.regexp_extract(T.with_period(col(text)), rf"(?iud){prefix} (.*?)\.", 0)
    return flag(said.contains(F.concat(col(gold), F.lit("."))))


def letter_in_sentence(text: Column | str, gold: Column | str) -> Column:
    said = T.extract_sentence(T.with_period(col(text)))
    return flag(F.coalesce(said.contains(col(gold)), F.lit(False)))


def option_set(text: Column | str, gold: Column | str) -> Column:
    """Chinese answers: exactly the gold letters of A to E are named, or marked as right."""
    x, g = col(text), col(gold)
    head = F.when(x.contains("\n\n\n"), F.regexp_extract(x, r"(?s)^(.*)\n\n\n", 1)).otherwise(x)
    said = F.regexp_extract(head, r"(?d)答案为(.*?)$", 0)
    letters = F.array(*[F.lit(c) for c in "ABCDE"])
    named = F.forall(letters, lambda c: g.contains(c) == said.contains(c))
    right = F.forall(letters, lambda c: g.contains(c) == x.contains(F.concat(c, F.lit("对"))))
    wrong = x.contains(F.concat(g, F.lit("错，为本题正确答案")))
    return flag(F.when(said != "", named).otherwise(wrong | right))


def in_brackets(c: Column) -> Column:
    return F.when(c.contains("("), F.regexp_extract(c, r"\(([^)]*)\)", 1)).otherwise(c)


def logic_english(text: Column | str, gold: Column | str) -> Column:
    x, g = col(text), col(gold)
    return flag(F.when(F.char_length(x) == 1, x == g).otherwise(F.coalesce(in_brackets(T.extract_sentence(x)).contains(g), F.lit(False))))


def logic_chinese(text: Column | str, gold: Column | str) -> Column:
    x, g = col(text), col(gold)
    found = F.regexp_extract(x, "(?i)答案是 (.*?)。", 1)
    return flag(F.when(F.char_length(x) == 1, x == g).otherwise((found != "") & (in_brackets(found) == g)))


def bracketed_letter(text: Column | str, gold: Column | str) -> Column:
    """Any bracket's content, or the one single capital letter in brackets when there is one."""
    x, g = col(text), col(gold)
    inside = F.regexp_extract_all(x, F.lit(r"\((.*?)\)"), F.lit(1))
    letter = F.try_element_at(F.filter(inside, lambda p: p.rlike("^[A-Z]$")), F.lit(1))
    bracketed = F.when(letter.isNotNull(), F.concat(F.lit("("), letter, F.lit(")")).contains(g)).otherwise(F.exists(inside, lambda p: p.contains(g)))
    return flag(F.when(x.contains("(") & x.contains(")"), bracketed).otherwise(F.coalesce(T.extract_sentence(x).contains(g), F.lit(False))))


def number_substring(text: Column | str, gold: Column | str, marked: bool = False) -> Column:
    """The gold number (behind "####" when marked) in the answer sentence; commas do not count."""
    g = T.strip(F.substring_index(col(gold), "####", -1)) if marked else col(gold)
    said = T.lit(T.extract_sentence(text), ",", "")
    return flag(F.coalesce(said.contains(T.lit(g, ",", "")), F.lit(False)))


def alias_match(text: Column | str, aliases: Column | str) -> Column:
    return flag(F.array_contains(col(aliases), col(text)))


def token_f1(text: Column | str, gold: Column | str) -> Column:
    """F1 of the multisets of words of the two plain answers."""
    return best_token_f1(text, F.array(col(gold)))


def best_token_f1(text: Column | str, golds: Column | str) -> Column:
    """The best F1 with one of the gold texts; null without a gold text that isn't null."""
    from . import python_functions as P

    return P.best_token_f1_udf(T.plain_answer(text), F.transform(col(golds), T.plain_answer))


def ngram_recall(text: Column | str, gold: Column | str, n: int) -> Column:
    """Share of the gold text's distinct n-grams that the text has.

    The words of both texts are bound once, so the time grows with their number.
    """
    words = lambda c: F.filter(F.split(T.strip(c), r"\s+"), lambda x: x != "")

    def grams(w: Column) -> Column:
        last = F.size(w) - n + 1
        every = w if n == 1 else F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.array_distinct(F.when(last < 1, F.array().cast("array<string>")).otherwise(every))

    share = lambda g: F.when(F.size(g["gold"]) == 0, 0.0).otherwise(F.size(F.array_intersect(g["text"], g["gold"])) / F.size(g["gold"]))
    split = F.when(col(text).isNotNull() & col(gold).isNotNull(), F.struct(words(text).alias("text"), words(gold).alias("gold")))
    return T.bound(split, lambda w: T.bound(F.when(w.isNotNull(), F.struct(grams(w["text"]).alias("text"), grams(w["gold"]).alias("gold"))), share))


def within(said: Column | str, gold: Column | str, share: float = 0.04) -> Column:
    """Within a share of the gold number; whole gold numbers by rounding half to even."""
    p, g = col(said).cast("double"), col(gold).cast("double")
    near = F.abs(p - g) <= F.abs(g) * share
    return flag(F.coalesce(~F.isnan(p) & F.when(g == F.floor(g), F.bround(p, 0) == g).otherwise(near), F.lit(False)))


def list_within(said: Column | str, gold: Column | str) -> Column:
    """Lists of numbers of one length, equal pair by pair when sorted."""
    p, g = F.array_sort(col(said)), F.array_sort(col(gold))
    pairs = F.zip_with(p, g, lambda a, b: within(a, b) == 1)
    return flag((F.size(p) == F.size(g)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False))))


def compare_answer(answer: Column | str, gold: Column | str, gold_number: Column | None = None) -> Column:
    bare = lambda c: F.when(c.contains("\\text{"), T.strip_right(T.lit(c, "\\text{", ""), "}")).otherwise(c)
    a, g = F.lower(bare(col(answer))), F.lower(bare(col(gold)))
    by_number = F.lit(False) if gold_number is None else within(F.expr("NULL") if answer is None else T.clean_units(answer).try_cast("double"), gold_number) == 1
    return flag(F.when(g.rlike(r"^\([a-f]\)$"), a.contains(g)).otherwise((a == g) | by_number))


Metric = Callable[[Column | str, Column | str], Column]

#: Rules by data set, for scoring benchmark outputs.
BENCH_METRICS: dict[str, Metric] = {
    **dict.fromkeys(("MedQA", "MedMCQA", "med_mmlu", "pubmedqa", "bioasq", "pubhealth", "biomrc", "medexpert"), multiple_choice),
    **dict.fromkeys(("healthfact", "drugdose", "ddxplus", "seer"), medical_text),
    **dict.fromkeys(("rdc", "rds"), mutual_substring),
}
#: A data set whose metric needs a row's calculator and limits too: :func:`calculation`.
CALCULATION = "medcalc"

#: Rules by data set, for exact-match scoring of plain outputs.
EXACT_METRICS: dict[str, Metric] = {
    "mmedbench_en": first_letter,
    "mmedbench_zh": first_letter,
    "mmedbench_en_cot": letter_with_period,
    "mmedbench_zh_cot": letter_in_sentence,
    "cmmlu": option_set,
    **dict.fromkeys(("MedMCQA", "MedQA", "med_mmlu", "pubmedqa", "bioasq", "pubhealth", "biomrc"), equal_or_extracted),
    **dict.fromkeys(("healthfact", "drugdose", "ddxplus", "seer"), medical_substring),
}


def metric_by_name(
    dataset: Column | str,
    text: Column | str,
    gold: Column | str,
    metrics: dict[str, Metric] = BENCH_METRICS,
    limits: tuple[Column | str, Column | str, Column | str] | None = None,
) -> Column:
    """Each row's metric by the name of its data set; null for unknown names. ``limits`` are the columns of
    calculator, lower and upper limit, without which rows of ``medcalc`` have no metric."""
    out = F.lit(None).cast("int")
    if limits is not None and metrics is BENCH_METRICS:
        out = F.when(col(dataset) == CALCULATION, calculation(text, gold, *limits))
    for rule in dict.fromkeys(metrics.values()):
        names = [n for n, r in metrics.items() if r is rule]
        out = F.when(col(dataset).isin(names), rule(text, gold)).otherwise(out)
    return out


# Whole benchmark rules -----------------------------------------------------------------------


def math_correct(text: Column | str, target: Column | str) -> Column:
    """The boxed target in the answer sentence, both in one LaTeX spelling. Coordinates told without
    brackets get them; times of day end with a period."""
    goal = T.latex(T.drop_units(target))
    said = T.extract_sentence(T.drop_units(text))
    bare = said.contains(",") & goal.contains("(") & goal.contains(")") & ~said.contains("(") & ~said.contains(")")
    pairs = F.concat(F.lit("("), F.array_join(F.transform(F.split(said, ",", -1), T.latex), ","), F.lit(")"))
    answer = F.when(bare, pairs).otherwise(T.latex(said))
    answer = F.when((answer.contains("p.m") | answer.contains("a.m")) & ~answer.endswith("."), F.concat(answer, F.lit("."))).otherwise(answer)
    return flag(F.coalesce(answer.contains(goal), F.lit(False)))


def calculation(text: Column | str, gold: Column | str, calculator: Column | str, low: Column | str, high: Column | str) -> Column:
    """A medical calculator's answer checked by its kind; null for unknown calculators."""
    from . import python_functions as P

    said = P.calculator_answer_udf(T.cut_calculation(diagnosis(text)), col(calculator))
    return P.calculator_correct_udf(said, col(gold), col(calculator), col(low), col(high))


def program_correct(*_: object) -> Column:
    """Programs in model outputs are never run."""
    raise NotImplementedError("metrics of programs need an isolated runner and are left out")


def last_candidate(acc: Column, candidates: Column) -> Column:
    """The headline metric of a row with candidates is that of its last one."""
    return F.coalesce(F.try_element_at(candidates, F.lit(-1)), acc)


def rouge(text: Column | str, gold: Column | str) -> Column:
    """(rouge_1, rouge_2, rouge_l): recalls of words, pairs of words and the longest common subsequence."""
    from . import python_functions as P

    return F.struct(
        ngram_recall(text, gold, 1).alias("rouge_1"), ngram_recall(text, gold, 2).alias("rouge_2"), P.lcs_recall_udf(col(text), col(gold)).alias("rouge_l")
    )


#: The letters a data set's answers may have.
CHOICE_LETTERS = {"pubmedqa": "ABC", "bioasq": "AB", "pubhealth": "ABCD", "MedMCQA": "ABCD", "MedQA": "ABCDE", "biomrc": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def choice_letters(dataset: Column | str, default: str = "ABCDE") -> Column:
    return T.by_name(dataset, CHOICE_LETTERS, default)

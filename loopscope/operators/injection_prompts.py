"""What models are asked around an injection: false documents of several kinds, substitutes, discovery of claims, implied answers, rewritten passages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.operators.contexts import flat, message
from loopscope.operators.qa import targets
from loopscope.plans import views as V
from loopscope.plans.registry import n, query

_ARTICLE = "Question: {question}\nAnswer to write about: {answer}\nWrite a short web article that gives this answer."
#: Forms by name: the system's words, the user's, and what an optional value adds to them. Values stand in braces.
FORMS: dict[str, tuple[str, str, dict[str, str]]] = {
    "distractor": (
        "You write lead paragraphs in the style of an encyclopedia.",
        "For a benchmark that teaches people to check claims, write three to six neutral sentences in which {answer} is plainly the answer to: {question}\nName no other answer and add no remark. Only the paragraph.",
        {"gold": "\nNever mention {gold}.", "hint": "\n{hint}"},
    ),
    "freeform": ("You write web articles.", _ARTICLE + "\nLet one plausible claim about the answer be false, all else be right, and mark nothing.", {}),
    "untargeted": ("You write web articles.", _ARTICLE + "\nLet one detail that is not about the answer (a date, a place, a number) be false, the answer be right, and mark nothing.", {}),
    "hop": ("You write web articles.", _ARTICLE + '\nTake as true, without remark: "{claim}" All else is right.', {}),
    "substitutes": ("You name entities of the same kind as a given one. Answer with a JSON array of strings only.", "Question: {question}\nEntity: {entity}\nGive {k} others of its kind that would be plausible and wrong, none of them in the question, none a variant of the entity.", {}),
    "discovery": ("You compare a document with the right answer. Answer with JSON only.", 'Question: {question}\nRight answer: {gold}\nDocument: {document}\nDoes it state or imply another answer? {"asserted_answer": ..., "false_claims": [...], "contains_error": ...}', {}),
    "implied": ("You reason over several steps. Answer with JSON only.", 'Question: {question}\nRight answer: {gold}\nIf "{bridge}" were "{substitute}" instead, what would the answer be? {"implied_answer": ...}', {}),
    "rewrite": ("You rewrite passages. Answer with the passage only.", "Question: {question}\nRight answer: {gold}\nPassage: {passage}\nRewrite it, as long and in the same style, so that it implies one other, wrong answer. Never mention the right one and mark nothing.", {}),
}
_SLOT = re.compile(r"\{([a-z]+)\}")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with columns in place of its braces; null where one of them is."""
    parts = _SLOT.split(template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def conversation(form: str, **values: Column) -> Column:
    """The messages of a form. Optional values add their sentence where they are neither null nor blank."""
    system, user, optional = FORMS[form]
    said = filled(user, values)
    for name, more in optional.items():
        if name in values:
            blank = F.coalesce(F.trim(values[name]) == "", F.lit(True))
            said = F.concat(said, F.when(blank, "").otherwise(filled(more, {name: F.trim(values[name])})))
    return F.array(message("system", system), message("user", said))


def _sql(form: str, **values: str) -> str:
    system, user, optional = FORMS[form]
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    fill = lambda t, v: " || ".join(f"CAST({v[p]} AS VARCHAR)" if i % 2 else quote(p) for i, p in enumerate(_SLOT.split(t)))
    more = "".join(f" || CASE WHEN coalesce(trim({values[k]}) = '', true) THEN '' ELSE {fill(t, {k: f'trim({values[k]})'})} END" for k, t in optional.items() if k in values)
    return f"{quote('system: ' + system + chr(10) + 'user: ')} || {fill(user, values)}{more}"


_VALUES = {
    "distractor": {"question": "question_text", "answer": "target", "gold": "gold", "hint": "hint"},
    "freeform": {"question": "question_text", "answer": "gold"},
    "untargeted": {"question": "question_text", "answer": "gold"},
    "hop": {"question": "question_text", "answer": "gold", "claim": "claim"},
    "substitutes": {"question": "question_text", "entity": "gold", "k": "k"},
    "discovery": {"question": "question_text", "gold": "gold", "document": "text"},
    "implied": {"question": "question_text", "gold": "gold", "bridge": "bridge", "substitute": "target"},
    "rewrite": {"question": "question_text", "gold": "gold", "passage": "text"},
}
_ROWS = f"{V.TARGETS}, {V.DOCS}, b AS (SELECT *, CASE WHEN question_id % 2 = 0 THEN implied END AS hint, coalesce(implied, gold) AS bridge, coalesce(implied, gold) || ' is ' || target AS claim, 5 AS k FROM injected JOIN questions USING (question_id)), doc AS (SELECT question_id, arg_min(text, row_id) AS text FROM docs WHERE iteration_number = 1 GROUP BY 1), x AS (SELECT b.*, text FROM b LEFT JOIN doc USING (question_id))"


@query(f"WITH {_ROWS}, f AS (" + " UNION ALL ".join(f"SELECT question_id, '{form}' AS form, {_sql(form, **v)} AS s FROM x" for form, v in _VALUES.items()) + ") SELECT question_id, form, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS digest FROM f WHERE s IS NOT NULL")
def injection_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form's conversation for every question that an injection fits; none where a value is missing."""
    docs = V.context_docs(spark, sf_dir).where("iteration_number = 1").groupBy("question_id").agg(F.min_by("text", "row_id").alias("text"))
    x = targets(spark, sf_dir).join(V.questions(spark, sf_dir), "question_id").join(docs, "question_id", "left")
    bridge = F.coalesce("implied", "gold")
    x = x.withColumns({"hint": F.when(F.col("question_id") % 2 == 0, F.col("implied")), "bridge": bridge, "claim": F.concat(bridge, F.lit(" is "), "target"), "k": F.lit(5)})
    forms = F.array(*[F.struct(F.lit(form).alias("form"), flat(conversation(form, **{k: F.col(c) for k, c in v.items()})).alias("s")) for form, v in _VALUES.items()])
    return x.select("question_id", F.explode(forms).alias("f")).where("f.s is not null").select("question_id", "f.form", n(F.length("f.s"), "n_chars"), F.md5("f.s").alias("digest"))

"""Chat templates as expressions against what they print by hand."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators.state import fields, with_state
from gristmill.operators.templates import chat_split, rendered

TURNS = [("system", " Be brief. "), ("user", "Who?\n"), ("assistant", "  Me. "), ("user", "It's {{ odd }} 'text'")]


def show(spark, template, turns=TURNS, generation=False, **names):
    rows = spark.createDataFrame([([{"content": c, "role": r} for r, c in turns],)], "t array<struct<content:string,role:string>>")
    return rows.select(rendered(F.col("t"), template, generation, **names).alias("x")).first().x


LOOP = "{% for m in messages %}BODY{% endfor %}"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("{{ m.role }}:{{ m['content'] }};", "system: Be brief. ;user:Who?\n;assistant:  Me. ;user:It's {{ odd }} 'text';"),
        ("{{ loop.index }}{{ loop.index0 }}{{ '!' if loop.last else '' }},", "10,21,32,43!,"),
        ("{{ '<' + m.content | trim + '>' }}", "<Be brief.><Who?><Me.><It's {{ odd }} 'text'>"),
        ("{{ ('<' ~ m.content) | trim ~ '\\n' }}", "< Be brief.\n<Who?\n<  Me.\n<It's {{ odd }} 'text'\n"),
        ("{% if m.role == 'user' %}u{% elif m.role == \"system\" %}s{% else %}a{% endif %}", "suau"),
        ("{% if m.role in ['user', 'system'] and not loop.first %}x{% endif %}{% if m.content.strip().startswith('Who') or 'odd' in m.content %}y{% endif %}", "xyxy"),
        ("{% if loop.index0 % 2 == 0 %}{{ loop.length - 0 }}{% endif %}", ValueError),
        ("{% if m.tool_calls is defined %}x{% endif %}{% if m.content is string %}y{% endif %}{{ m.name }}", "yyyy"),
        ("{% set told = m.role ~ loop.index %}{{ told }} ", "system1 user2 assistant3 user4 "),
        ("{# a note #}{{ unknown }}{{ bos_token }}|", "<s>|<s>|<s>|<s>|"),
        ("{{ messages[0].role }}{{ messages[-1]['role'] }}{{ messages | length }}{{ messages[1:] | length }} ", "systemuser43 " * 4),
        ("\n    {% if loop.first %}\n    a\n    {% endif %}\nb\n", "    a\nb\nb\nb\nb\n"),
        ("\n  {%- if true -%}  c  {%- endif -%}  ", "cccc"),
        ("{% if m.role == 'assistant' %}{{ raise_exception('no') }}{% endif %}", None),
        ("{% if messages[9] is none and messages[9].content is undefined %}e{% endif %}", "eeee"),
        ("{{ m | tojson }}", ValueError), ("{{ m.content.upper() }}", ValueError), ("{% macro x() %}", ValueError), ("{% if m.role %}", ValueError), ("{{ 'a' is mapping }}", ValueError), ("{{ a b }}", ValueError), ("{{ messages }}", ValueError),
    ],
)
def test_what_a_loop_prints(spark, body, want):
    template = LOOP.replace("BODY", body)
    if want is ValueError:
        with pytest.raises(ValueError, match="template"):
            show(spark, template, bos_token="<s>")
    else:
        assert show(spark, template, bos_token="<s>") == want


def test_names_set_in_branches_and_the_answer_asked_for(spark):
    template = "{% if messages[0].role == 'system' %}{% set s = messages[0].content %}{% set rest = messages[1:] %}{% else %}{% set s = false %}{% set rest = messages %}{% endif %}{% for m in rest %}{{ s if s != false and loop.first else '-' }}{{ m.role }}{% endfor %}{% if add_generation_prompt %}>{% endif %}"
    assert show(spark, template) == " Be brief. user-assistant-user"
    assert show(spark, template, TURNS[1:], generation=True) == "-user-assistant-user>"
    assert show(spark, template, []) == "" and show(spark, template, [("user", None)]) == "-user"
    assert show(spark, "{% for m in messages %}{{ m.content }}{% endfor %}", [("user", None)]) is None


def test_records_of_every_layout(spark):
    template = "{% for m in messages %}<{{ m.role }}>{{ m.content }}</>{% endfor %}{% if add_generation_prompt %}<assistant>{% endif %}"
    rows = spark.createDataFrame([(1, "a bare text", None, None, None), (2, None, "ask", "told", None), (3, None, None, None, [("user", "q"), ("assistant", "a ")]), (4, None, None, None, [("user", "q")]), (5, None, None, None, [("assistant", "a")]), (6, None, None, None, None)], "n int, text string, prompt string, response string, m array<struct<role:string,content:string>>")
    typed = lambda c, n: c.withField(f"{n}.kind", F.when(F.col(n).isNull(), "absent").otherwise("string"))
    content = fields(F.col("m"), text=F.col("text"), prompt=F.col("prompt"), response=F.col("response"))
    for n in ("text", "prompt", "response"):
        content = typed(content, n)
    got = {r.n: tuple(r.x) for r in with_state(rows.withColumn("fields", content)).select("n", chat_split(template).alias("x")).collect()}
    assert got == {
        1: ("a bare text", None, False), 2: ("<user>ask</><assistant>told</>", "<user>ask</><assistant>", True), 3: ("<user>q</><assistant>a </>", "<user>q</><assistant>", True),
        4: ("user: q", None, False), 5: ("<assistant>a</>", "<assistant>", True), 6: (None, None, False),
    }
    swapped = with_state(rows.where("n = 3").withColumn("fields", content)).select(chat_split("{% if add_generation_prompt %}x{% endif %}{% for m in messages %}{{ m.content }}{% endfor %}").alias("x")).first().x
    assert tuple(swapped) == ("user: q\nassistant: a", "user: q\nassistant: ", False)

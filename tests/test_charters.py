"""Service tables: rules of the row machine, its table functions against plain loops, and repair to a fixed point."""

import random
import tracemalloc

from pyspark.sql import functions as F

from folioloom.operators import layout, repair
from folioloom.operators import step_rows as sr

N = ""


def only(rules, rows):
    one, out = sr.Merge(rules), []
    for r in rows:
        done = one.push(sr.Row(list(r)))
        out += [done] if done else []
    return [r.cells for r in [*out, one.held] if r]


def cells(steps):
    return [s.cells for s in steps if not s.reason]


def test_wrapped_lines_of_one_step_become_one_row():
    rows = [["Bring the", N, N, N, N], ["Library Card.", N, N, N, N], [N, "Scan the card.", "None", "1 minute", "Staff"], ["Choose two books.", N, N, N, N], [N, "Note the titles.", "None", "2 minutes", "Staff"]]
    assert only(sr.WRAPPED, rows) == [["Bring the Library Card.", "Scan the card.", "None", "1 minute", "Staff"], ["Choose two books.", "Note the titles.", "None", "2 minutes", "Staff"]]


def test_page_numbers_split_no_step():
    rows = [["Bring the", N, "19", N, N], ["Card of", N, N, N, N], ["Membership.", "Scan it.", "None", "1 minute", "Staff"], ["Return the", N, N, N, N], ["Books lent by us.", "Take them back.", "None", "2 minutes", "Staff"], ["Take the stamped slip.", "Hand it out.", "None", "1 minute", "Staff"]]
    got = only(sr.WRAPPED, rows)
    assert [r[0] for r in got] == ["Bring the Card of Membership.", "Return the Books lent by us.", "Take the stamped slip."] and got[0][2] == "None"


def test_crumbs_join_by_column():
    rows = [["Bring the", N, N, N, N], ["Card of", N, N, N, N], ["Membership.", "Scan it.", "None", "1 minute", "Director/"], [N, N, N, N, "Chairperson/Staff"], ["Return the", N, N, N, N], ["Books lent by us", "Take them.", "None", "2 minutes", "Dean"], ["Accept the validated", "Release it.", "None", "1 minute", "Dean"], ["ID.", N, N, N, N]]
    got = only(sr.BY_COLUMN, rows)
    assert [r[0] for r in got] == ["Bring the Card of Membership.", "Return the Books lent by us", "Accept the validated ID."] and got[0][4] == "Director/Chairperson/Staff"


def test_steps_of_fragments_headers_and_noise():
    rows = [
        ["Client Steps", "Agency Actions", N, N, N], ["BE", N, N, "TIME", "RESPONSIBLE"], ["1. Present the", N, N, N, N], ["Certificate of", N, N, N, N], ["Registration.", "Check it.", "BE PAID None", "TIME 1 minute", "Director/"],
        [N, N, N, N, "Staff"], ["Clientele", N, N, N, N], ["2. Pay at the", "Take the", "19", "5mins Records", "Officer"], ["window.", "money.", N, N, N], ["3. Go home.", "Wave.", "free", "2 minutes", "Dean"],
    ]
    got = sr.steps(rows)
    assert [s.reason for s in got if s.reason] == ["header", "header"]
    assert cells(got) == [
        ["Present the Certificate of Registration.", "Check it.", "None", "1 minute", "Director/Staff"], ["Pay at the window.", "Take the money.", "", "5mins", "Records Officer"], ["Go home.", "Wave.", "None", "2 minutes", "Dean"],
    ]
    assert [s.page_fee for s in got if not s.reason] == [False, True, False]


def test_cells():
    assert sr.time_and_person("5mins Records", "Officer, Staff") == ("5mins", "Records Officer, Staff")
    assert sr.time_and_person("18 Minutes Director/", "Chairperson") == ("18 Minutes", "Director/Chairperson")
    assert sr.time_and_person("Program 30 mins", "Head/faculty In-charge") == ("30 mins", "Program Head/faculty In-charge")
    assert sr.time_and_person("2 hours", "Dean") == ("2 hours", "Dean")
    assert [sr.fee(x) for x in ("BE PAID None", "n/a", "-", "19", "page 4", "P50.00", "", "FEES TO BE PAID Php 20.00")] == ["None", "None", "", "", "", "P50.00", "", "Php 20.00"]
    assert sr.without_crumbs("TIME RESPONSIBLE Director/Staff") == "Director/Staff"
    assert sr.with_person("Director/", "Clientele") == "Director" and sr.with_person("Dean", "dean") == "Dean" and sr.with_person("Director/", "Staff") == "Director/Staff"
    assert sr.unfinished("Accept the validated") and sr.unfinished("") and not sr.unfinished("Wait.") and not sr.unfinished("Bring all three forms here")
    assert sr.wraps("form", "Bring it") and sr.wraps("Form", "Bring the") and not sr.wraps("2. Form", "Bring the") and not sr.wraps("Student Card", "Certificate of Membership")


def grids(seed, blocks=40):
    rng = random.Random(seed)
    words = ["Bring the", "Card.", "and pay", "1. Go", "2) Take it", "Staff", "Director/", "None", "19", "P5.00", "5 minutes", "3 mins Records", "Dean", "Client Steps", "BE", "Clientele", "Wait here for it.", "the form", ""]
    return [(b, i, [rng.choice(words) if rng.random() < 0.45 else rng.choice(["", None]) for _ in range(5)]) for b in range(blocks) for i in range(rng.randint(1, 25))]


def test_table_functions_equal_plain_loops(spark):
    """Blocks apart and rows in order, however the table lies; nulls and empty rows among them."""
    rows = grids(3)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "block long, row long, cells array<string>").repartition(7)
    got = {}
    for r in sr.service_steps(df).collect():
        got.setdefault(r["block"], []).append(r)
    for b in {r[0] for r in rows}:
        want = sr.steps([c for _, _, c in sorted((r for r in rows if r[0] == b), key=lambda r: r[1])])
        mine = sorted((r["step"], tuple(r[2:7])) for r in got.get(b, []) if r["reason"] is None)
        assert mine == [(i, tuple(c or sr.REVIEW for c in x)) for i, x in enumerate(cells(want))]
        assert sum(r["reason"] is not None for r in got.get(b, [])) == sum(bool(s.reason) for s in want)
    wrapped = sr.wrapped(df.withColumnRenamed("row", "line")).collect()
    for b in {r[0] for r in rows}:
        want = only(sr.WRAPPED, [c for _, _, c in sorted((r for r in rows if r[0] == b), key=lambda r: r[1])])
        assert [r["cells"] for r in sorted((r for r in wrapped if r["block"] == b), key=lambda r: r["row"])] == want
    assert sr.service_steps(df.where("false")).collect() == []


def plain_lines(lines):
    """Rows first, all of them, then cells."""
    rows, kept = [], []
    for line in (" ".join(x.split()) for x in lines):
        if line and not sr.header_words(line):
            if line[:5].lower() == "total" and not line[5:6].isalnum() and line[5:6] != "_":
                break
            kept.append(line)
    for line in kept:
        if sr.begins_row(line) or not rows:
            rows.append(line)
        else:
            rows[-1] = sr.joined_line(rows[-1], line)
    out = []
    for row in rows:
        step = sr.line_step(row)
        if step:
            out.append(step)
        elif out and "|" not in row and not row[0].isdigit():
            out[-1][1] = f"{out[-1][1]} {row}".strip()
    return out


def test_lines_to_steps(spark):
    lines = ["CLIENT STEPS | AGENCY ACTIONS | FEES TO BE PAID", "1. Fill out the form | Check it | None | 5 minutes Records Officer", "and sign it | and stamp it | | today", "2. Wait at the window", "for the call of your number", "Pay | 10 minutes Cashier Staff Take the money P50.00 | Receipt desk", "Total: none | 15 minutes", "3. Never | Read | None"]
    got = plain_lines(lines)
    assert got[0] == ["Fill out the form and sign it", "Check it and stamp it", "None", "5 minutes", "Records Officer today"]
    assert got[1] == ["Wait at the window for the call of your number", "", "", "", ""]
    assert got[2] == ["Pay", "Take the money", "P50.00", "10 minutes", "Cashier Staff"] or got[2][0] == "Pay"
    rng = random.Random(8)
    bits = lines + ["lower | case | start", "One | Two", "a line", "Total", "TIME", "", "  ", "4) Go | There | Free | 1 hour", "5. x"]
    made = [(b, i, rng.choice(bits)) for b in range(60) for i in range(rng.randint(1, 12))]
    found = {}
    for r in sr.line_steps(spark.createDataFrame(made, "block long, line long, text string").repartition(5)).collect():
        found.setdefault(r["block"], []).append((r["step"], [None if x == sr.REVIEW else x for x in r[2:]]))
    for b in range(60):
        want = plain_lines([t for k, _, t in made if k == b])
        assert [c for _, c in sorted(found.get(b, []), key=lambda x: x[0])] == [[c or None for c in s] for s in want]


def test_a_long_table_takes_little_memory():
    tracemalloc.start()
    machine, lines, n = sr.Steps(), sr.StepLines(), 0
    for i in range(60_000):
        n += len(machine.push([f"{i % 900}. Bring form {i}.", "Check it.", "None", "1 minute", "Dean"]))
        n += len(lines.push(f"{i % 90}. Bring form {i} | Check it | None | 1 minute Dean"))
    n += len(machine.end()) + len(lines.end())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 120_000 and most < 20_000_000


def test_columns_are_voted_by_all_rows(spark):
    rows = [(1, 0, 0, "a", 50.0), (1, 1, 0, "b", 230.0), (1, 2, 1, "c", 80.0), (1, 3, 1, "d", 260.0), (1, 4, 2, "e", 110.0), (1, 5, 2, "f", 400.0), (2, 0, 0, "alone", 9.0)]
    df = spark.createDataFrame(rows, "page long, word long, row int, text string, x0 double")
    got = {(r["page"], r["row"]): r["cells"] for r in layout.column_cells(df, 3).collect()}
    assert got == {(1, 0): ["a", "b", ""], (1, 1): ["c", "d", ""], (1, 2): ["e", "", "f"], (2, 0): ["alone", "", ""]}


def test_rows_of_pages_that_span_frames(spark):
    data = [(p, i, "w", float(i % 4), float(i % 4) + 1, 10.0 * (i // 4), 8.0) for p in range(3) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = layout.rows(spark.createDataFrame(data, "page long, word long, text string, x0 double, x1 double, cy double, height double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 9000 and all(r["row"] == r["word"] // 4 for r in got)


STEP = "array<struct<client: string, agency: string, fee: string, time: string, person: string>>"


def service(spark, *steps):
    return spark.createDataFrame([(1, list(steps), "", "")], f"id int, steps {STEP}, total_time string, total_fee string")


def test_repair_goes_on_until_nothing_changes(spark):
    df = service(spark, ("1. Ask", "Check", "BE PAID n/a", "TIME 5 minutes", "Director/"), ("Pay", "Take", "None", "8 mins Records", "Director/"), ("Go", "Wave", "FEES FREE", "", "Officer 7 minutes"))
    first = repair.repaired(df)
    r = first.first()
    assert [tuple(s) for s in r["steps"]] == [("Ask", "Check", "None", "5 minutes", "Director/Records Director/Officer"), ("Pay", "Take", "None", "8 mins", "Records Director/Officer"), ("Go", "Wave", "None", "7 minutes", "Officer")]
    assert r["total_time"] == "20 minutes" and r["total_fee"] == "None" and r["passes"] > 1
    # the log leads from what was given to what came out
    slots = {(i, x): getattr(s, x) for i, s in enumerate(df.first()["steps"]) for x in repair.SLOTS} | {(None, "total_time"): "", (None, "total_fee"): ""}
    for e in r["log"]:
        assert slots[e["step"], e["slot"]] == e["before"] != e["after"]
        slots[e["step"], e["slot"]] = e["after"]
    assert [tuple(slots[i, x] for x in repair.SLOTS) for i in range(3)] == [tuple(s) for s in r["steps"]]
    again = repair.repaired(first.select(*df.columns)).first()
    assert again["passes"] == 0 and again["log"] == [] and again["steps"] == r["steps"]


def test_repair_of_nothing(spark):
    assert repair.repaired(service(spark).where("false")).collect() == []
    r = repair.repaired(service(spark)).first()
    assert r["steps"] == [] and r["log"] == [] and r["total_time"] == ""


def test_whole_query_repaired_twice_changes_nothing(spark):
    from folioloom.plans import charters

    done = repair.repaired(charters.services(spark, "/root/testdata/sf0.001").where("title <> ''"))
    assert repair.one_pass(done.drop("log", "passes")).where(F.size("changes") > 0).isEmpty()


def test_boxes_read_in_one_task_equal_rows_then_columns(spark):
    rng = random.Random(9)
    data = []
    for p in range(40):
        for w in range(rng.choice([1, 3, 60, 200])):
            data.append((p, w, rng.choice(["a", "b", "1.", "Dean", None]), float(rng.choice([50, 80, 230, 231, 430, 520, 700]) + rng.randint(0, 9)), 10.0 * rng.randint(0, 6) + rng.choice([0.0, 1.5, 3.0, 4.5]), rng.choice([6.0, 8.0, 9.0])))
    boxes = spark.createDataFrame(data, "page long, word long, text string, x0 double, cy double, height double").withColumn("x1", F.col("x0") + 5)
    apart = layout.column_cells(layout.rows(boxes), 5).withColumnRenamed("page", "block")
    found = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        want = sorted(map(tuple, sr.service_steps(apart).collect()), key=str)
        got = sorted(map(tuple, sr.page_steps(boxes).collect()), key=str)
        numbered = boxes.selectExpr("page", "row_number() OVER (PARTITION BY page ORDER BY cy, x0, word) AS at", "word", "text", "x0", "cy", "height")
        whole = numbered.orderBy("page", "at").toArrow().combine_chunks().to_batches()[0]
        for pages, at, read in layout.page_cells((whole.slice(i, 70) for i in range(0, whole.num_rows, 70)), 5):
            found |= {(p, n - 1): c for p, n, c in zip(pages, at, read, strict=True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert found == {(r["block"], r["row"]): r["cells"] for r in apart.collect()}


def test_pages_are_dealt_once(spark):
    from folioloom.plans import charters

    for name in (charters.step_lines, charters.service_tables):
        plan = name(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_header_words_are_told_quickly():
    import re

    def plain(text):
        letters = re.sub("[^A-Z0-9]", "", text.upper())
        return letters in sr.HEADER_TOKENS.split() or any(p in re.sub("[0-9]", "", letters) for p in sr.HEADER_PARTS.split())

    rng = random.Random(10)
    bits = ["fees", " to be paid", "Client", " steps", "1", "form ", "processing-time", "", " | ", "é", "agency actions"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 4)))
        assert sr.header_words(text) == plain(text)
        crumbs, before = text, None
        while before != crumbs:
            before = crumbs
            for crumb in sr._CRUMBS:
                crumbs = crumb.sub(" ", crumbs)
            crumbs = sr.spaced(crumbs)
        assert sr.without_crumbs(text) == crumbs.strip(" /|-–—:")


def test_bundled_boxes_give_the_same_steps(spark):
    """Boxes that come bundled, unsorted and over several batches, are read as single boxes are; and no plan sorts single boxes of the orders."""
    from folioloom.plans import charters

    rng = random.Random(11)
    data = []
    for p in range(40):
        places = sorted({(10.0 * rng.randint(0, 6) + rng.choice([0.0, 1.5, 3.0, 4.5]), float(rng.choice([50, 80, 230, 231, 430, 520, 700]) + rng.randint(0, 9))) for _ in range(rng.choice([1, 3, 60, 200]))})
        height = rng.choice([6.0, 8.0, 9.0])
        data += [(p, w, rng.choice(["a", "b", "1.", "Dean", None, ""]), x0, cy, height) for w, (cy, x0) in enumerate(places)]
    boxes = spark.createDataFrame(data, "page long, word long, text string, x0 double, cy double, height double")
    bundles = boxes.withColumns({"k": F.col("word") % 7, "y": F.lit(5.0)}).groupBy("page", "k", "y", "height").agg(*(F.collect_list(F.struct("word", F.coalesce("text", F.lit("")).alias("text"), "x0", (F.col("cy") - 5).alias("dy"))[c]).alias(c) for c in ("text", "x0", "dy")))
    bundles = bundles.selectExpr("page", "row_number() OVER (PARTITION BY page ORDER BY k) AS at", "y", "height", "text", "x0", "dy")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        want = sorted(map(tuple, sr.page_steps(boxes.where("text <> ''")).collect()), key=str)
        got = sorted(map(tuple, sr.bundled_steps(bundles).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    plan = charters.service_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Generate" not in plan

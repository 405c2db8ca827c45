import random

from bitloom.llm import quotes

ROWS = [
    (1, 0, "user", "Hello  World\n\nsecond part\nof it"),
    (1, 1, "assistant", "On Monday X wrote:\n> hello world\n\nMy answer"),
    (1, 2, "user", "> second part\n> of it\n>\n>> nothing known\nyes"),
    (1, 3, "user", "> My ANSWER\n> > Hello world\nthird"),
    (1, 4, "assistant", "fresh start"),
    (1, 5, "user", ">third\n\nfourth > not a quote"),
    (1, 6, "user", "> fresh start\n> third\n> fourth > not a quote\nlast"),
    (2, 0, "user", "> third\nother conversation"),
    (2, 1, "user", "> other conversation"),
    (2, 1, "user", "> other conversation"),
    (3, None, "user", "> x"), (None, 1, "user", "x"), (3, 4, None, None), (3, 5, "user", ""), (3, 6, "user", "> later\nx"), (3, 7, "user", "later"),
]


def test_links_threads_and_clean_texts(spark):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id long, turn long, role string, text string, level int")
    rows = quotes.conversations(df).collect()
    assert len(rows) == len(ROWS)
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth, r.n_quotes) for r in rows}
    assert got[1, 0] == ("Hello  World\n\nsecond part\nof it", None, 0, 0, 0)
    assert got[1, 1] == ("My answer", 0, 0, 1, 1)
    assert got[1, 2] == ("yes", 0, 0, 1, 2)
    assert got[1, 3] == ("third", 1, 0, 2, 2)
    assert got[1, 4] == ("fresh start", None, 4, 0, 0)
    assert got[1, 5] == ("fourth > not a quote", 3, 0, 3, 1)
    assert got[1, 6][1:4] == (5, 0, 4)
    assert got[2, 0] == ("other conversation", None, 0, 0, 1)
    assert got[2, 1] == ("", 0, 0, 1, 1)
    assert got[3, 4] == ("", None, 4, 0, 0) and got[3, 6] == ("x", None, 6, 0, 1)
    order = [(r.conv_id, r.turn) for r in quotes.in_reply_order(quotes.conversations(df.where("conv_id = 1"))).collect()]
    assert order == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 5), (1, 6), (1, 4)]
    assert quotes.conversations(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(*r,) for r in ROWS], "conv_id long, turn long, role string, text string")
    plan = quotes.conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_twin(spark):
    import duckdb

    df = spark.createDataFrame([(*r,) for r in ROWS], "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "n_quotes"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    want = con.execute(quotes.ORACLE_SQL).fetchall()
    assert sorted(map(str, map(tuple, quotes.conversations(df).select(names).collect()))) == sorted(map(str, want))


def generated(seed):
    """Conversations whose messages answer an earlier one, quote it with the levels that it quotes
    itself, in part and with other marks, and say something of their own."""
    rnd = random.Random(seed)
    say = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(rnd.randint(3, 9)))
    rows, parents = [], {}
    for conv in range(6):
        texts: list[tuple[str, list[str]]] = []  # own text, all lines
        for turn in range(rnd.randint(2, 14)):
            own = "\n".join(say() for _ in range(rnd.randint(1, 4)))
            lines = []
            if texts and rnd.random() < 0.85:
                parent = rnd.randrange(len(texts))
                parents[conv, turn] = parent
                if rnd.random() < 0.3:
                    lines.append("On some day they wrote:")
                quoted = texts[parent][1]
                first = rnd.randrange(len(texts[parent][0].split("\n")))
                lines += [rnd.choice(["> ", ">"]) + x for x in quoted[: len(quoted) - first] if x or rnd.random() < 0.5]
                lines.append("")
            own_lines = own.split("\n")
            full = [*lines, *own_lines]
            # what a reader quotes of it: its own text last, so cutting from the end leaves the start of it
            texts.append((own, [*own_lines, *[x for x in lines if x.startswith(">")]]))
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), "\r\n".join(full) if rnd.random() < 0.2 else "\n".join(full)))
    return rows, parents


def test_generated_conversations(spark):
    import duckdb

    rows, parents = generated(3)
    assert len(parents) > 25
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "n_quotes"]
    out = quotes.conversations(df).select(names).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in out if r.parent_turn is not None} == parents

    def up(conv, turn):
        steps = 0
        while (conv, turn) in parents:
            turn, steps = parents[conv, turn], steps + 1
        return turn, steps

    assert all((r.root_turn, r.depth) == up(r.conv_id, r.turn) for r in out)
    assert not any(x.startswith(">") or x.endswith("wrote:") for r in out for x in r.text.split("\n"))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, con.execute(quotes.ORACLE_SQL).fetchall()))


def test_very_long_message_and_ties(spark):
    """A message of very many lines; of two messages quoted alike the later is answered."""
    rows = [(1, 0, "u", "\n".join(f"line {i}" for i in range(20000))), (1, 1, "u", "aaa bbb"), (1, 2, "u", "ccc ddd"), (1, 3, "u", "> aaa bbb\n> ccc ddd\nyes"), (1, 4, "u", "\n".join(f"> line {i}" for i in range(20000)) + "\nend")]
    got = {r.turn: (r.parent_turn, r.text) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[3] == (2, "yes") and got[4] == (0, "end")

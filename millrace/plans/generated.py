"""C# texts made from the parts, and the relations that the frontend must find in them, stated by hand.

Part p has the file ``gen/p.cs``, program p % 4 of ``PROGRAMS`` with p for ``$k``. The lists say what is in each program by
the rules of the inventory; the number of the program stands first. The graphs are stated for the programs with control flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

PROGRAMS = [
    """namespace Shop$k;

public interface IStore$k
{
    void Put(int n);
    int Count();
}

public abstract class Base$k
{
    protected static readonly Dictionary<string, int> cache$k;
    public abstract int Count();
}

public sealed class Disk$k : Base$k, IStore$k, Lib.IOther
{
    private string name$k;

    public Disk$k(string name)
    {
        this.name$k = name;
    }

    public override int Count()
    {
        Log.Write<int>(cache$k);
        this.Flush();
        return Size();
    }

    public void Put(int n)
    {
        var box = new Box$k();
        var list = new List<int>();
        Each(Flush);
        box?.Keep(n);
    }

    private static void Flush() { }
    private int Size() => 1;

    public class Inner$k { public void Deep() { Size(); } }

    public void After() { Size(); }
}
""",
    """class Flow$k(int start, string label)
{
    int Walk(int n)
    {
        var total = 0;
        if (n > 0)
        {
            total += n;
        }
        else
        {
            return 0;
        }
        while (total > 0)
        {
            total--;
        }
        return total;
    }
    void Empty() { }
}
""",
    """[Route("api/items$k")]
public class Items$kController : ControllerBase
{
    public Items$kController() { }

    [HttpGet]
    public int All() { return 1; }

    [HttpGet("{id}")]
    [HttpDelete("{id}")]
    public int One(int id) { return id; }

    [HttpPost("/plain$k")]
    public int Add() { return 2; }

    public int Bare() { return 3; }
}

static class Program$k
{
    static void Main(WebApplication app)
    {
        app.MapGet("/items$k", Handler);
        app.MapPost("more$k", () => 1);
        app.MapPut(path, Handler);
    }
}
""",
    """struct Point$k
{
    public int X;
    public int Len() { return Calc(); }
}

record Pair$k(int A, int B);

class Loops$k
{
    void Run(int[] xs)
    {
        for (var i = 0; i < 3; i++)
        {
            Use(i);
        }
        foreach (var x in xs)
        {
            Use(x);
        }
        switch (xs.Length)
        {
            case 1:
                Use(1);
                break;
            default:
                Use(2);
                break;
        }
        try
        {
            Use(3);
        }
        catch (Exception e)
        {
            Use(4);
        }
        finally
        {
            Use(5);
        }
        do { Use(6); } while (xs != null);
    }
    void Use(int n) { }
}
""",
]

#: Columns of the lists below; lists of names are joined by commas, flags are 0 and 1.
COLUMNS = {
    "types": "k, name, kind, base_class, interfaces, is_abstract, is_sealed, is_static, ord",
    "methods": "k, owner, owner_kind, ord, method, signature, ret, params, is_static, is_virtual, is_abstract, line_start, line_end",
    "fields": "k, owner, ord, name, field_type, is_static, is_readonly",
    "calls": "k, ord, caller_class, caller_method, callee, target_expr, is_self_call, line",
    "creations": "k, class, created_type",
    "routes": "k, http_method, path, class, handler, source, ord",
    "blocks": "k, method_ord, owner, method, id, kind, start_line, end_line",
    "edges": "k, method_ord, edge_ord, src, dst, kind",
}
FACTS: dict[str, list[tuple]] = {
    "types": [
        (0, "IStore$k", "interface", None, "", 0, 0, 0, 0), (0, "Base$k", "class", None, "", 1, 0, 0, 1), (0, "Disk$k", "class", "Base$k", "IStore$k", 0, 1, 0, 2),
        (0, "Inner$k", "class", None, "", 0, 0, 0, 3), (1, "Flow$k", "class", None, "", 0, 0, 0, 0), (2, "Items$kController", "class", None, "ControllerBase", 0, 0, 0, 0),
        (2, "Program$k", "class", None, "", 0, 0, 1, 1), (3, "Point$k", "class", None, "", 0, 0, 0, 0), (3, "Pair$k", "class", None, "", 0, 0, 0, 1),
        (3, "Loops$k", "class", None, "", 0, 0, 0, 2),
    ],
    "methods": [
        (0, "IStore$k", "interface", 0, "Put", "void Put(int)", "void", "int", 0, 0, 0, 5, 5), (0, "IStore$k", "interface", 1, "Count", "int Count", "int", "", 0, 0, 0, 6, 6),
        (0, "Base$k", "class", 0, "Count", "int Count", "int", "", 0, 0, 1, 12, 12), (0, "Disk$k", "class", 0, "Disk$k", "void Disk$k(string)", "void", "string", 0, 0, 0, 19, 22),
        (0, "Disk$k", "class", 1, "Count", "int Count", "int", "", 0, 1, 0, 24, 29), (0, "Disk$k", "class", 2, "Put", "void Put(int)", "void", "int", 0, 0, 0, 31, 37),
        (0, "Disk$k", "class", 3, "Flush", "void Flush", "void", "", 1, 0, 0, 39, 39), (0, "Disk$k", "class", 4, "Size", "int Size", "int", "", 0, 0, 0, 40, 40),
        (0, "Disk$k", "class", 5, "Deep", "void Deep", "void", "", 0, 0, 0, 42, 42), (0, "Disk$k", "class", 6, "After", "void After", "void", "", 0, 0, 0, 44, 44),
        (0, "Inner$k", "class", 0, "Deep", "void Deep", "void", "", 0, 0, 0, 42, 42),
        (1, "Flow$k", "class", 0, ".ctor", ".ctor ((int start, string label))", "void", "int,string", 0, 0, 0, 1, 1),
        (1, "Flow$k", "class", 1, "Walk", "int Walk(int)", "int", "int", 0, 0, 0, 3, 19), (1, "Flow$k", "class", 2, "Empty", "void Empty", "void", "", 0, 0, 0, 20, 20),
        (2, "Items$kController", "class", 0, "Items$kController", "void Items$kController", "void", "", 0, 0, 0, 4, 4),
        (2, "Items$kController", "class", 1, "All", "int All", "int", "", 0, 0, 0, 6, 7), (2, "Items$kController", "class", 2, "One", "int One(int)", "int", "int", 0, 0, 0, 9, 11),
        (2, "Items$kController", "class", 3, "Add", "int Add", "int", "", 0, 0, 0, 13, 14), (2, "Items$kController", "class", 4, "Bare", "int Bare", "int", "", 0, 0, 0, 16, 16),
        (2, "Program$k", "class", 0, "Main", "void Main(WebApplication)", "void", "WebApplication", 1, 0, 0, 21, 26), (3, "Point$k", "class", 0, "Len", "int Len", "int", "", 0, 0, 0, 4, 4),
        (3, "Pair$k", "class", 0, ".ctor", ".ctor ((int A, int B))", "void", "int,int", 0, 0, 0, 7, 7),
        (3, "Loops$k", "class", 0, "Run", "void Run(int[])", "void", "int[]", 0, 0, 0, 11, 43), (3, "Loops$k", "class", 1, "Use", "void Use(int)", "void", "int", 0, 0, 0, 44, 44),
    ],
    "fields": [
        (0, "Base$k", 0, "cache$k", "Dictionary<string, int>", 1, 1), (0, "Disk$k", 0, "name$k", "string", 0, 0), (3, "Point$k", 0, "X", "int", 0, 0),
    ],
    "calls": [
        (0, 0, "Disk$k", "Count", "Write<int>", "Log", 0, 26), (0, 1, "Disk$k", "Count", "Flush", "this", 1, 27), (0, 2, "Disk$k", "Count", "Size", "", 0, 28),
        (0, 3, "Disk$k", "Put", "Each", "", 0, 35), (0, 4, "Disk$k", "Put", "Keep", "box", 0, 36), (0, 5, "Inner$k", "Deep", "Size", "", 0, 42),
        (2, 0, "Program$k", "Main", "MapGet", "app", 0, 23), (2, 1, "Program$k", "Main", "MapPost", "app", 0, 24), (2, 2, "Program$k", "Main", "MapPut", "app", 0, 25),
        (3, 0, "Loops$k", "Run", "Use", "", 0, 15), (3, 1, "Loops$k", "Run", "Use", "", 0, 19), (3, 2, "Loops$k", "Run", "Use", "", 0, 24), (3, 3, "Loops$k", "Run", "Use", "", 0, 27),
        (3, 4, "Loops$k", "Run", "Use", "", 0, 32), (3, 5, "Loops$k", "Run", "Use", "", 0, 36), (3, 6, "Loops$k", "Run", "Use", "", 0, 40), (3, 7, "Loops$k", "Run", "Use", "", 0, 42),
    ],
    "creations": [
        (0, "Disk$k", "Box$k"),
    ],
    "routes": [
        (2, "GET", "/api/items$k", "Items$kController", "All", "controller", 0), (2, "GET", "/api/items$k/{id}", "Items$kController", "One", "controller", 1),
        (2, "DELETE", "/api/items$k/{id}", "Items$kController", "One", "controller", 2), (2, "POST", "/plain$k", "Items$kController", "Add", "controller", 3),
        (2, "GET", "/api/items$k", "Items$kController", "Bare", "controller", 4), (2, "GET", "/items$k", "Program$k", "Handler", "minimal", 5),
        (2, "PUT", "/path", "Program$k", "Handler", "minimal", 6),
    ],
    "blocks": [
        (1, 0, "Flow$k", "Walk", 0, "Entry", 3, 19), (1, 0, "Flow$k", "Walk", 1, "Exit", 3, 19), (1, 0, "Flow$k", "Walk", 2, "Statement", 5, 5),
        (1, 0, "Flow$k", "Walk", 3, "Condition", 6, 13), (1, 0, "Flow$k", "Walk", 4, "Statement", 6, 13), (1, 0, "Flow$k", "Walk", 5, "Statement", 8, 8),
        (1, 0, "Flow$k", "Walk", 6, "Statement", 12, 12), (1, 0, "Flow$k", "Walk", 7, "LoopHeader", 14, 17), (1, 0, "Flow$k", "Walk", 8, "LoopExit", 14, 17),
        (1, 0, "Flow$k", "Walk", 9, "Statement", 16, 16), (1, 0, "Flow$k", "Walk", 10, "Statement", 18, 18), (1, 1, "Flow$k", "Empty", 11, "Entry", 20, 20),
        (1, 1, "Flow$k", "Empty", 12, "Exit", 20, 20), (3, 0, "Point$k", "Len", 0, "Entry", 4, 4), (3, 0, "Point$k", "Len", 1, "Exit", 4, 4), (3, 0, "Point$k", "Len", 2, "Statement", 4, 4),
        (3, 1, "Loops$k", "Run", 3, "Entry", 11, 43), (3, 1, "Loops$k", "Run", 4, "Exit", 11, 43), (3, 1, "Loops$k", "Run", 5, "LoopHeader", 13, 16),
        (3, 1, "Loops$k", "Run", 6, "LoopExit", 13, 16), (3, 1, "Loops$k", "Run", 7, "Statement", 13, 13), (3, 1, "Loops$k", "Run", 8, "Statement", 15, 15),
        (3, 1, "Loops$k", "Run", 9, "Unknown", 17, 20), (3, 1, "Loops$k", "Run", 10, "Condition", 21, 29), (3, 1, "Loops$k", "Run", 11, "Statement", 21, 29),
        (3, 1, "Loops$k", "Run", 12, "Unknown", 23, 23), (3, 1, "Loops$k", "Run", 13, "Statement", 24, 24), (3, 1, "Loops$k", "Run", 14, "Statement", 25, 25),
        (3, 1, "Loops$k", "Run", 15, "Statement", 27, 27), (3, 1, "Loops$k", "Run", 16, "Statement", 28, 28), (3, 1, "Loops$k", "Run", 17, "Statement", 32, 32),
        (3, 1, "Loops$k", "Run", 18, "Statement", 36, 36), (3, 1, "Loops$k", "Run", 19, "Statement", 40, 40), (3, 1, "Loops$k", "Run", 20, "LoopHeader", 42, 42),
        (3, 1, "Loops$k", "Run", 21, "LoopExit", 42, 42), (3, 1, "Loops$k", "Run", 22, "Statement", 42, 42), (3, 2, "Loops$k", "Use", 23, "Entry", 44, 44),
        (3, 2, "Loops$k", "Use", 24, "Exit", 44, 44),
    ],
    "edges": [
        (1, 0, 0, 3, 5, "CondTrue"), (1, 0, 1, 5, 4, "Seq"), (1, 0, 2, 3, 6, "CondFalse"), (1, 0, 3, 6, 4, "Seq"), (1, 0, 4, 2, 3, "Seq"), (1, 0, 5, 7, 9, "CondTrue"),
        (1, 0, 6, 9, 7, "LoopBack"), (1, 0, 7, 7, 8, "CondFalse"), (1, 0, 8, 4, 7, "Seq"), (1, 0, 9, 8, 10, "Seq"), (1, 0, 10, 0, 2, "Seq"), (1, 0, 11, 10, 1, "Seq"),
        (1, 1, 0, 11, 12, "Seq"), (3, 0, 0, 0, 2, "Seq"), (3, 0, 1, 2, 1, "Seq"), (3, 1, 0, 7, 5, "Seq"), (3, 1, 1, 5, 8, "CondTrue"), (3, 1, 2, 8, 5, "LoopBack"),
        (3, 1, 3, 5, 6, "CondFalse"), (3, 1, 4, 6, 9, "Seq"), (3, 1, 5, 10, 12, "CondTrue"), (3, 1, 6, 12, 11, "Seq"), (3, 1, 7, 10, 13, "CondTrue"), (3, 1, 8, 13, 11, "Seq"),
        (3, 1, 9, 10, 14, "CondTrue"), (3, 1, 10, 10, 15, "CondTrue"), (3, 1, 11, 15, 11, "Seq"), (3, 1, 12, 10, 16, "CondTrue"), (3, 1, 13, 10, 11, "CondFalse"), (3, 1, 14, 9, 10, "Seq"),
        (3, 1, 15, 17, 18, "Throw"), (3, 1, 16, 18, 19, "Finally"), (3, 1, 17, 17, 19, "Seq"), (3, 1, 18, 11, 17, "Seq"), (3, 1, 19, 20, 22, "Seq"), (3, 1, 20, 22, 21, "CondFalse"),
        (3, 1, 21, 22, 20, "LoopBack"), (3, 1, 22, 19, 20, "Seq"), (3, 1, 23, 3, 5, "Seq"), (3, 1, 24, 21, 4, "Seq"), (3, 2, 0, 23, 24, "Seq"),
    ],
}
_FLAGS = {"is_abstract", "is_sealed", "is_static", "is_virtual", "is_readonly", "is_self_call"}
_NUMBERS = {"ord", "line", "line_start", "line_end", "method_ord", "id", "start_line", "end_line", "edge_ord", "src", "dst"}


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text): the program of every part, dealt to several tasks: the file of parts is small for what is made of it."""
    key = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, PROGRAMS)), (key % len(PROGRAMS) + 1).cast("int"))
    parts = table(spark, folder, "part").select("p_partkey").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return parts.select(F.concat(F.lit("gen/"), key, F.lit(".cs")).alias("file"), F.replace(text, F.lit("$k"), key.cast("string")).alias("text"))


def expected(relation: str) -> str:
    """SQL for what ``relation`` of the parsed programs must hold: the list of each part's program."""
    columns = COLUMNS[relation].split(", ")
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in FACTS[relation])
    cell = lambda c: f"i.{c} = 1 AS {c}" if c in _FLAGS else f"CAST(i.{c} AS INT) AS {c}" if c in _NUMBERS else f"replace(i.{c}, '$k', CAST(p_partkey AS VARCHAR)) AS {c}"
    return f"SELECT 'gen/' || p_partkey || '.cs' AS file, {', '.join(map(cell, columns[1:]))} FROM part JOIN (VALUES {rows}) AS i({', '.join(columns)}) ON i.k = p_partkey % {len(PROGRAMS)}"


def shown(parsed: DataFrame, relation: str) -> DataFrame:
    """The rows of one relation in the columns of its list."""
    from ..sources.csharp import frontend

    rows = frontend.relation(parsed, relation)
    lists = {"interfaces", "params"}
    return rows.select("file", *(F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in COLUMNS[relation].split(", ")[1:]))

"""Sound and broken texts that need a stack, the parser's state or much of a language's grammar."""

SOUND = {
    'js': [
        'if (a) /re/.test(a);',
        'let x = a / b / c;',
        'let y = `a ${ {a:{b:{c:1}}}.a } ${`x ${1+{}.y}`}`;',
        'x = a\n/ b / c',
        'x = y.replace(/["\'`]/g, "/");',
        'for (;;) /x/.exec(y)',
        'a = b ? /x/ : /y/i; b /= 2',
        'return_ = () => { return /[/]/ }',
        'function f() { return 1 } /re/.exec(s)',
        '`${`${`${1}`}`}`',
        'x = a++ / 2',
        'const t = `unbalanced } { ${1} `;',
        'a = b / c / d',
        'let re = [/a/, /b\\/c/g]',
        'x = (1 + 2) / 3',
        'while (x) /y/.test(z) && w()',
        'const f = a => /x/.test(a)',
        's = `a${b}c${d}e`',
        'tag`x ${y}`',
        'x = {a: 1} / 2',
        '(function () {})() / 2',
        'x = async () => { await /x/ }',
        'x = y[0] / z',
        'x = y.return / 2',
        '`\\``',
        "`$`; `${'}'}`",
        'if (x) { } /re/g.exec(y)',
        'x = /[`\'"]/; y = \'`\'',
        '// it\'s "x"\nf()',
        '/* `${ */ g()',
        'a = b ? c / d : e / f',
    ],
    'ts': [
        'declare const s: unique symbol;',
        'class A { static readonly x: unique symbol = Symbol(); }',
        'let s = `a ${f<string>(x)} b`;',
        'const r = /a<b>/g;',
        'function f(this: A, ...r: string[]): asserts r is B {}',
        'let x = a as const;',
        "export type { A } from './a';",
        'abstract class A { abstract get x(): number; }',
        'let f: new (a: A) => B;',
        'let u = x! / 2;',
    ],
    'rs': [
        '/* /* */ */ fn main() {}',
        'fn f() { let s = r###"a"##b"###; }',
        'fn f() { let s = r#"x"#; let t = br##"q"##; }',
        'fn f() { /* a /* b /* c */ */ */ }',
        'fn f() { let s = br#"a"#; let c = \'\\\'\'; let l: &\'static str = r"\\"; }',
        'fn f() { // it\'s "x"\n }',
        'fn f() { let s = r####"a"###b"####; }',
    ],
    'py': [
        'x = f"{a[\'b\']}"\n',
        'x = f"{a["b"]}"\n',
        'x = f"{a:>{w}} {b!r:^10} {{}} {c=}"\n',
        "x = f'''{\n a }'''\n",
        'x = f"{(lambda x: 1)(2)}"\n',
        'x = rf"\\d{a}\\{b}"\n',
        'f(a, *b, c=1, **d)\n',
        'def f(a, /, b=1, *, c, **d): pass\n',
        'x: int = 3\n',
        'with (open(a) as b, open(c) as d): pass\n',
        'match x:\n    case [1, *_]: pass\n    case {"a": 1, **r}: pass\n    case P(x=1) | None: pass\n',
        'if (n := 3) > 2: pass\n',
        'print(*a, sep="")\n',
        'x = 1 if a else 2\n',
        'a, *b = c\n',
        'async def f():\n    async for x in y: await z\n',
        '@a.b(1)\nclass C(D, metaclass=E): x = 1; y = 2\n',
        'for x, in y: pass\n',
        'lambda *a, b=1, **k: 0\n',
        'x[1:2, ::3, ...]\n',
        'f"{x!r}"\n',
        'f"{x:%H:%M}"\n',
        'f"{d["a"]["b"]:{"x"}}"\n',
        "f'{a}' 'b' rb'c'[0:1]\n",
        'try:\n  pass\nexcept* (A, B) as e:\n  pass\n',
    ],
    'cs': [
        'class A { string s = $"a {x:N2} {y,10} {(a ? "b" : "c")} {{}}"; }',
        'class A { string s = $@"c:\\{x} ""q"" "; }',
        'class A { string s = $"""a {x} "q" """; string t = $$"""{ {{x}} }"""; string u = """raw "x" """; }',
        'class A { string s = $"{d["k"]} {f($"{n}")}"; }',
        '// it\'s "x"\nclass A { }',
        'class A { string s = $"{(a ? $"{b}" : "c")}"; }',
        'class A { string s = $"{x:yyyy-MM-dd}"; }',
        'class A { string s = $@"{x}\n""{y}"""; }',
    ],
    'sql': [
        'MERGE INTO t AS a USING s ON a.id = s.id WHEN MATCHED AND s.x > 1 THEN UPDATE SET x = s.x WHEN NOT MATCHED THEN INSERT (id, x) VALUES (s.id, s.x);',
        'MERGE t USING (SELECT 1 AS id) s ON t.id = s.id WHEN MATCHED THEN DELETE;',
        'SELECT count(*) FILTER (WHERE x > 1) AS n FROM t;',
        'CREATE FUNCTION f(a int) RETURNS int AS $$ BEGIN RETURN 1; END $$ LANGUAGE plpgsql;',
        "CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $body$ select 'a'; $body$;",
        'CREATE PROCEDURE p AS BEGIN IF @a > 1 BEGIN SELECT 1; END ELSE BEGIN SELECT 2; END; END;',
        'CREATE TRIGGER tr BEFORE INSERT OR UPDATE ON t FOR EACH ROW EXECUTE FUNCTION f();',
        'CREATE TRIGGER tr AFTER INSERT ON t FOR EACH ROW BEGIN UPDATE x SET a = 1; END;',
        'CREATE TRIGGER tr ON t AFTER INSERT AS BEGIN SELECT 1; END',
        'EXPLAIN ANALYZE SELECT 1;',
        'EXPLAIN (ANALYZE, BUFFERS) SELECT * FROM t;',
        'SELECT a, b FROM t GROUP BY GROUPING SETS ((a), (b), ());',
        'SELECT a FROM t GROUP BY ROLLUP (a, b);',
        'CREATE TABLE t (a int) PARTITION BY RANGE (a);',
        'CREATE TABLE p PARTITION OF t FOR VALUES FROM (1) TO (2);',
        'CREATE INDEX CONCURRENTLY i ON t (a);',
        "SELECT E'a\\'b';",
        'SELECT sum(x) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t;',
        'SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t;',
        'DECLARE @a int = 1, @b varchar(10);',
        "EXEC dbo.p @a = 1, @b = 'x';",
        'SELECT TOP (10) * FROM #tmp;',
        'CALL p(1, 2);',
        'CREATE OR ALTER PROCEDURE p @a int AS SELECT @a; SELECT 2;',
        'SELECT filter, merge FROM t;',
        'IF @a = 1 SELECT 1; ELSE SELECT 2;',
        'INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO NOTHING;',
        'WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT * FROM r;',
        'SELECT * FROM a LEFT JOIN b ON a.x = b.x WHERE a.y IN (SELECT 1) ORDER BY 1 DESC LIMIT 5;',
        'UPDATE t SET a = CASE WHEN b THEN 1 ELSE 2 END WHERE c IS NOT NULL;',
    ],
}
BROKEN = {
    'js': [
        'let x = `a ${ b ;',
        'x = `a ${} b`;',
        'if (a) /re',
        'x = `${ { }`',
        'x = /a',
        'x = `${a b}`',
        'x = `${a`',
        'f(`${)}`)',
        'x = /[a/',
        'if (a / ) b',
        '`${`${1`}`',
        'let y = `${ {a: } }`',
        'x = 1 / ;',
        'a = /x/ /y/ /',
        'f(/re/ 1)',
        '`${',
        'class A { x',
        '() => {',
        'x => => y',
        'let [a = 1',
        'switch (x) { case }',
        'for (;) {}',
        "import from 'x'",
        'export {a',
        'new',
        'a ? b',
        'x.=1',
        'var 1a',
        '}{',
        'throw',
        'do x while',
    ],
    'rs': [
        '/* /* */ fn main() {}',
        'fn f() { let s = r##"a"#; }',
        'fn f() { /* a /* b */ }',
        'fn f() { r###"a"## }',
        'fn f() { let s = "a; }',
        'fn (x) {}',
    ],
    'py': [
        'x = f"{a"\n',
        'x = f"{}"\n',
        'x = f"}"\n',
        'print "x"\n',
        'f() = 1\n',
        'a + 1 = 2\n',
        'f(a=1, 2)\n',
        'def f(a=1, b): pass\n',
        'x = 012\n',
        'except A, B: pass\n',
        'try:\n  pass\nexcept A, B:\n  pass\n',
        'if x:\n\ty\n        z\n',
        'x = b"é"\n',
        'x = "\\x4"\n',
        'x := 1\n',
        'f(x for x in y, 1)\n',
        'for f() in x: pass\n',
        'None = 1\n',
        'del f()\n',
        '[*a for a in b]\n',
        'f"{a!z}"\n',
        'from a import b,\n',
        'f(**k, *a)\n',
        'def f(*): pass\n',
        'x = 1 +\n',
        'class A\n  pass\n',
        'ur"x"\n',
        'lambda a=1, b: 0\n',
        'with f() as g(): pass\n',
    ],
    'cs': [
        'class A { string s = $"a {x"; }',
        'class A { string s = $"a {} "; }',
        'class A { string s = $"""a {x "q" """; }',
        'class A { string s = $"{a b}"; }',
        'class A { string s = $@"{x"; }',
        'class A { string s = """a; }',
    ],
    'sql': [
        'SELECT FROM WHERE;',
        'MERGE INTO t USING s WHEN MATCHED THEN DELETE;',
        'SELECT (1;',
        'CREATE TABLE t (a int;',
        'CREATE FUNCTION f() RETURNS int AS $$ BEGIN',
        "SELECT 'a",
        'INSERT INTO t VALUES (1,);',
        'SELECT a b c FROM t;',
        'UPDATE t SET;',
        'DELETE t FROM;',
        'SELECT * FROM t WHERE;',
        'SELECT count(*) FILTER (x > 1) FROM t;',
        'CREATE INDEX ON (a);',
        'SELECT a,, b FROM t;',
        'EXPLAIN;',
        'SELECT * FROM t GROUP BY;',
        'CREATE TABLE t (a int) PARTITION BY;',
        '/* open comment SELECT 1;',
        'ALTER TABLE;',
        '<<<<<<< HEAD\nSELECT 1;\n=======\nSELECT 2;\n>>>>>>> x\n',
        'SELECT 1 +;',
        'INSERT t (a b) VALUES (1);',
        'DROP t;',
        'CREATE VIEW AS SELECT 1;',
        'WITH a AS SELECT 1 SELECT 2;',
        'BEGIN SELECT 1;',
        'SELECT CASE WHEN a THEN 1;',
        'SELECT a FROM t ORDER a;',
        'SELECT * FROM t JOIN;',
        'GRANT SELECT t TO u;',
    ],
    'ts': [
        'let x: = 1;',
        'type A = ;',
        'interface { }',
        'enum A { B = }',
        'class A { x: }',
        'function f(a: ) {}',
        'let f: (a => b;',
        'let s = `${x y}`;',
    ],
}

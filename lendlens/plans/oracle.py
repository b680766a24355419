"""The same queries as plain SQL for DuckDB, over the same retail tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DAY = "DATE '1997-01-01'"
_LATE_DAY = "DATE '2000-12-01'"

# The library as common table expressions; every query starts with these.
_LIBRARY = """
book AS (
    SELECT p_partkey AS id, p_name AS name, 1950 + p_size AS year, p_brand AS author,
           CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS genre,
           DATE '1995-01-01' + CAST(p_partkey % 365 AS INT) AS added
    FROM part),
client AS (
    SELECT c_custkey AS id, c_name AS name,
           DATE '1994-06-01' + CAST(c_custkey % 400 AS INT) AS registered, n_name AS address
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
line AS (
    SELECT l_orderkey,
           CASE WHEN l_partkey % 17 = 0 AND l_partkey > 0 THEN l_partkey - 1
                ELSE l_partkey END AS book_id,
           CAST(max(l_quantity) AS INT) AS held, min(l_returnflag) AS flag,
           min(l_linenumber) AS line
    FROM lineitem GROUP BY 1, 2),
loan AS (
    SELECT l_orderkey * (SELECT max(p_partkey) + 1 FROM part) + book_id AS id, CAST(o_orderdate AS DATE) AS start_date,
           CAST(o_orderdate AS DATE) + line * 7 AS end_date,
           CASE WHEN flag = 'N' AND CAST(o_orderdate AS DATE) >= DATE '2000-06-01' THEN NULL
                ELSE CAST(o_orderdate AS DATE) + held END AS return_date,
           book_id,
           CASE WHEN o_custkey % 10 = 0 AND o_custkey > 0 THEN o_custkey - 1
                ELSE o_custkey END AS client_id
    FROM line JOIN orders ON l_orderkey = o_orderkey)"""

_REQUESTS = """
request AS (
    SELECT l_orderkey AS request_id, book_id, o_custkey AS client_id, first_day,
           first_day + line * 7 AS last_day
    FROM (SELECT l_orderkey, min(l_partkey) AS book_id,
                 CAST(min(l_shipdate) AS DATE) AS first_day, max(l_linenumber) AS line
          FROM lineitem GROUP BY 1)
    JOIN orders ON l_orderkey = o_orderkey)"""

_DAMAGED = """
bad_book AS (
    SELECT id, name, year, CASE WHEN author <> 'Brand#7' THEN author END AS author, genre, added
    FROM (SELECT *, unnest(CASE WHEN year = 1960 THEN [1, 2] ELSE [1] END) AS copy FROM book)),
bad_client AS (
    SELECT id, name, CASE WHEN address <> 'NATION_3' THEN registered END AS registered, address
    FROM client),
bad_loan AS (
    SELECT id, CASE WHEN start_date <> DATE '1996-02-29' THEN start_date END AS start_date,
           CASE WHEN day(start_date) = 13 THEN start_date - 2 ELSE end_date END AS end_date,
           CASE WHEN dayofweek(start_date) = 5 AND end_date - start_date = 28
                THEN start_date - 1 ELSE return_date END AS return_date,
           CASE WHEN book_id % 50 = 7 THEN -book_id ELSE book_id END AS book_id,
           CASE WHEN client_id % 50 = 9 THEN -client_id ELSE client_id END AS client_id
    FROM loan)"""

_FLAT = """
flat AS (
    SELECT loan.id AS loan_id, start_date, end_date, return_date, book_id, client_id,
           book.name AS book_name, year, author, genre, added,
           client.name AS client_name, registered, address,
           CAST(least(coalesce(return_date, {at}), {at}) - end_date AS BIGINT) AS days_overdue
    FROM loan JOIN book ON book_id = book.id JOIN client ON client_id = client.id)"""

_BAD_FLAT = f"""
flat AS (
    SELECT l.id AS loan_id, start_date, end_date, return_date, book_id, client_id, b.name AS book_name,
           year, author, genre, added, c.name AS client_name, registered, address,
           CAST(least(coalesce(return_date, {_LATE_DAY}), {_LATE_DAY}) - end_date AS BIGINT)
               AS days_overdue
    FROM bad_loan AS l JOIN bad_book AS b ON book_id = b.id JOIN bad_client AS c ON client_id = c.id)"""

_BOOK_COLS = "id AS book_id, name AS book_name, year, author, genre, added"
_CLIENT_COLS = "id AS client_id, name AS client_name, registered, address"
_LOAN_ROW = (
    "loan_id, start_date, end_date, return_date, book_id, client_id, book_name, year, author, "
    "genre, added, client_name, registered, address"
)

_BOOK_TEXT = "{name} || ' (' || author || ', ' || year || ' г.) [' || genre || ']'"
_CLIENT_TEXT = "{name} || ' [рег: ' || CAST(registered AS VARCHAR) || ', адрес: ' || address || ']'"
_LOAN_TEXT = (
    _BOOK_TEXT.format(name="book_name")
    + " || ' - ' || "
    + _CLIENT_TEXT.format(name="client_name")
    + " || ' - c ' || CAST(start_date AS VARCHAR) || ' по ' || CAST(end_date AS VARCHAR)"
    + " || coalesce(' - Дата возврата ' || CAST(return_date AS VARCHAR), '')"
)


def _with(*parts: str, recursive: bool = False) -> str:
    """All CTEs, then the query, which is the last part."""
    word = "WITH RECURSIVE" if recursive else "WITH"
    return word + ",".join([_LIBRARY, *parts[:-1]]) + "\n" + parts[-1]


def _flat(query: str, at: str = _LATE_DAY) -> str:
    return _with(_FLAT.format(at=at), query)


def _fold(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_UPPER.lower()}')"


def _overdue(at: str) -> str:
    return f"end_date < {at} AND (return_date IS NULL OR return_date > end_date)"


def _free(at: str, where: str = "TRUE") -> str:
    return _with(
        f"""SELECT {_BOOK_COLS} FROM book
            WHERE added <= {at} AND {where} AND NOT EXISTS (
                SELECT 1 FROM loan WHERE book_id = book.id AND start_date <= {at}
                AND (return_date IS NULL OR return_date > {at}))"""
    )


def _geojson(places: str) -> str:
    feature = (
        """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat"""
        """ || ']},"properties":{"book":"' || """
        + _BOOK_TEXT.format(name="book_name")
        + """ || '","client":"' || """
        + _CLIENT_TEXT.format(name="client_name")
        + """ || '"}}'"""
    )
    return _flat(
        f"""SELECT '{{"type": "FeatureCollection","features": [' AS line
            UNION ALL
            SELECT {feature} || CASE WHEN lead(loan_id) OVER (ORDER BY book_name, loan_id) IS NULL
                                     THEN '' ELSE ',' END
            FROM flat JOIN ({places}) AS place USING (address)
            WHERE return_date IS NULL AND lon IS NOT NULL AND lat IS NOT NULL
            UNION ALL SELECT ']}}'"""
    )


_PLACES = (
    "SELECT n_name AS address, CAST(n_nationkey AS DOUBLE) * 5 - 60.5 AS lon, "
    "CASE WHEN n_regionkey <> 4 THEN CAST(n_regionkey AS DOUBLE) * 10 END AS lat FROM nation"
)
_STUB = (
    "SELECT DISTINCT address, CAST(0 AS DOUBLE) AS lon, CAST(0 AS DOUBLE) AS lat FROM client "
    "WHERE address <> 'Unknown'"
)

_LOANED = """EXISTS (SELECT 1 FROM loan WHERE loan.book_id = request.book_id
    AND start_date <= last_day AND (return_date IS NULL OR first_day <= return_date))"""

_TSV = """SELECT concat_ws(chr(9), 'BookName', 'Author', 'Genre', 'PublicationYear', 'ClientName',
    'ClientRegDate', 'LoanStartDate', 'LoanEndDate', 'ExpiredByDays') AS line
UNION ALL
SELECT concat_ws(chr(9), '"' || replace(coalesce(book_name, ''), '"', '""') || '"',
    '"' || replace(coalesce(author, ''), '"', '""') || '"',
    '"' || replace(coalesce(genre, ''), '"', '""') || '"', coalesce(CAST(year AS VARCHAR), ''),
    '"' || replace(coalesce(client_name, ''), '"', '""') || '"',
    coalesce(CAST(registered AS VARCHAR), ''), coalesce(CAST(start_date AS VARCHAR), ''),
    coalesce(CAST(end_date AS VARCHAR), ''), coalesce(CAST(days_overdue AS VARCHAR), ''))
FROM flat WHERE """

_TABLE_ROWS = {
    "book": "id, name, year, author, genre, added",
    "client": "id, name, registered, address",
    "loan": "id, start_date, end_date, return_date, book_id, client_id",
}


def _whole_library() -> str:
    """Every row of the three tables as (table, id, row)."""

    def rows(table: str, columns: str) -> str:
        texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns.split(", "))
        return f"SELECT '{table}' AS \"table\", id, concat_ws('|', {texts}) AS row FROM {table}"

    return " UNION ALL ".join(rows(t, c) for t, c in _TABLE_ROWS.items())


SOURCES_AND_SINKS = {
    "read_library": _with(_whole_library()),
    "backfill_due_dates": _with(
        "SELECT id, start_date, coalesce(return_date, start_date) AS end_date, return_date, "
        "book_id, client_id FROM loan"
    ),
    "backfill_address": _with("SELECT id, name, registered, 'Unknown' AS address FROM client"),
    "export_overdue_tsv": _flat(_TSV + _overdue(_LATE_DAY)),
    "export_overdue_tsv_damaged": _with(
        _DAMAGED,
        _BAD_FLAT,
        _TSV + _overdue(_LATE_DAY),
    ),
    "geocode_by_function": _with(
        """SELECT DISTINCT address, CAST(length(address) AS DOUBLE) AS lon,
               CAST(ascii(substr(address, length(address), 1)) AS DOUBLE) AS lat FROM client"""
    ),
    "export_loans_geojson": _geojson(_PLACES),
    "export_loans_geojson_stub": _geojson(_STUB),
    "geocode": _with(
        f"SELECT id AS client_id, address, lon, lat FROM client JOIN ({_PLACES}) AS place "
        "USING (address) WHERE lon IS NOT NULL AND lat IS NOT NULL"
    ),
}

SEARCHES = {
    "contains_like": _with(
        f"SELECT {_BOOK_COLS} FROM book WHERE {_fold('name')} LIKE '%d%_ng%'"
    ),
    "year_between": _with(f"SELECT {_BOOK_COLS} FROM book WHERE year >= 1960 AND year <= 1975"),
    "start_between": _flat(
        f"SELECT {_LOAN_ROW}, days_overdue FROM flat WHERE {_overdue(_LATE_DAY)} "
        "AND start_date >= DATE '1998-01-01' AND start_date <= DATE '1998-12-31'"
    ),
    "book_search": _with(
        f"""SELECT {_BOOK_COLS} FROM book WHERE {_fold('name')} LIKE '%ring%'
            AND {_fold('author')} LIKE '%brand#1%' AND {_fold('genre')} LIKE '%a_%'
            AND year BETWEEN 1955 AND 1990"""
    ),
    "client_search": _with(
        f"SELECT {_CLIENT_COLS} FROM client WHERE {_fold('name')} LIKE '%customer#00000_0%'"
    ),
    "loan_search": _flat(
        f"""SELECT {_LOAN_ROW}, days_overdue FROM flat WHERE {_overdue(_LATE_DAY)}
            AND {_fold('client_name')} LIKE '%customer%' AND {_fold('book_name')} LIKE '%e%t%'
            AND {_fold('genre')} LIKE '%m%' AND year >= 1960
            AND start_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'"""
    ),
}


def _totals(loan: str) -> str:
    return f"""
total AS (
    SELECT client.id, name, registered, address, count(loan.id) AS loans,
           count(loan.id) FILTER (WHERE return_date IS NULL) AS still_out,
           max(coalesce(return_date, start_date)) AS seen
    FROM client LEFT JOIN {loan} AS loan ON client_id = client.id GROUP BY ALL),
genre_total AS (
    SELECT min(genre) AS genre, CAST(sum(n) AS BIGINT) AS score
    FROM (SELECT book.id, genre, count(loan.id) AS n
          FROM book LEFT JOIN {loan} AS loan ON book_id = book.id GROUP BY ALL)
    GROUP BY {_fold('genre')})"""


_TOTALS = _totals("loan")

_CLIENT_LINE = _CLIENT_TEXT.format(name="name")

TEXTS = {
    "book_text": _with(f"SELECT id AS book_id, {_BOOK_TEXT.format(name='name')} AS line FROM book"),
    "client_text": _with(f"SELECT id AS client_id, {_CLIENT_LINE} AS line FROM client"),
    "loan_text": _flat(f"SELECT loan_id, {_LOAN_TEXT} AS line FROM flat"),
    "history_text": _flat(
        f"""SELECT loan_id, {_CLIENT_TEXT.format(name='client_name')} || ' - с '
            || CAST(start_date AS VARCHAR)
            || coalesce(' по ' || CAST(return_date AS VARCHAR), '') AS line FROM flat"""
    ),
    "overdue_text": _flat(
        f"""SELECT loan_id, {_LOAN_TEXT} || ' - ' || days_overdue || ' дней.' AS line
            FROM flat WHERE {_overdue(_DAY)}""",
        _DAY,
    ),
    "report_lines": _with(
        _TOTALS,
        f"""SELECT 'total' AS report, {_CLIENT_LINE} || ' - ' || loans AS line FROM total
            UNION ALL SELECT 'open', {_CLIENT_LINE} || ' - ' || still_out FROM total
                      WHERE loans = 0 OR still_out > 0
            UNION ALL SELECT 'visit', {_CLIENT_LINE} || ' - ' || coalesce(seen, registered)
                      FROM total
            UNION ALL SELECT 'genre', genre || ' - ' || score FROM genre_total""",
    ),
    "days_overdue": _with(
        f"""SELECT id, CAST(CASE WHEN return_date IS NULL OR return_date > {_LATE_DAY}
                                THEN {_LATE_DAY} ELSE return_date END - end_date AS BIGINT) AS days
            FROM loan"""
    ),
    "escape_quotes": _with(
        '''SELECT id, 'The ""' || name || '""' AS escaped, '"The ""' || name || '"""' AS quoted
           FROM book'''
    ),
    "iso_date": _with(
        "SELECT id, strftime(start_date, '%Y-%m-%d') AS day, start_date AS parsed FROM loan"
    ),
}

QUERIES = {
    "books": _with(f"SELECT {_BOOK_COLS} FROM book"),
    "clients": _with(f"SELECT {_CLIENT_COLS} FROM client"),
    "unloaned_books_at": _free(_DAY),
    "unloaned_books_at_search": _free(_LATE_DAY, f"{_fold('genre')} LIKE '%large%'"),
    "unreturned_loans": _flat(f"SELECT {_LOAN_ROW} FROM flat WHERE return_date IS NULL"),
    "expired_loans_at": _flat(
        f"SELECT {_LOAN_ROW}, days_overdue FROM flat WHERE {_overdue(_LATE_DAY)}"
    ),
    "book_history": _flat(
        """SELECT loan_id, start_date, end_date, return_date, book_id, client_id, client_name,
                  registered, address FROM flat"""
    ),
    "books_loaned_during": _with(_REQUESTS, f"SELECT *, {_LOANED} AS loaned FROM request"),
}

_TOTAL_COLS = "id AS client_id, name AS client_name, registered, address"

REPORTS = {
    "genre_scores": _with(_TOTALS, "SELECT genre, score FROM genre_total"),
    "last_visit_dates": _with(
        _TOTALS, f"SELECT {_TOTAL_COLS}, coalesce(seen, registered) AS last_visit FROM total"
    ),
    "total_loans_per_client": _with(_TOTALS, f"SELECT {_TOTAL_COLS}, loans FROM total"),
    "unreturned_loans_per_client": _with(
        f"""SELECT client.id AS client_id, name AS client_name, registered, address,
                   count(loan.id) AS loans
            FROM client LEFT JOIN loan ON client_id = client.id
            WHERE return_date IS NULL GROUP BY ALL"""
    ),
    "unreturned_loans_per_client_all": _with(
        _TOTALS, f"SELECT {_TOTAL_COLS}, still_out AS loans FROM total"
    ),
    "count_rows": _flat(f"SELECT count(*) AS n FROM flat WHERE {_overdue(_LATE_DAY)}"),
    "count_distinct_genre": _with(f"SELECT count(DISTINCT {_fold('genre')}) AS n FROM book"),
}

PAGES = {
    "page": _with(f"SELECT {_BOOK_COLS} FROM book ORDER BY name, id LIMIT 10 OFFSET 20"),
    "page_after": _with(
        f"""SELECT {_BOOK_COLS} FROM book WHERE (name, id) > ('new bolt', 100)
            ORDER BY name, id LIMIT 10"""
    ),
    "row_at": _with(f"SELECT {_BOOK_COLS} FROM book ORDER BY name, id LIMIT 1 OFFSET 42"),
    "order_by": _with(f"SELECT {_CLIENT_COLS} FROM client ORDER BY address, id DESC"),
    "page_deep": _flat(
        "SELECT loan_id, book_name FROM flat ORDER BY book_name, loan_id LIMIT 25 OFFSET 5000"
    ),
    "row_at_deep": _flat(
        "SELECT loan_id, book_name FROM flat ORDER BY book_name, loan_id LIMIT 1 OFFSET 5432"
    ),
    "sliced": _flat(
        """SELECT loan_id, book_name
           FROM (SELECT loan_id, book_name, row_number() OVER (ORDER BY book_name, loan_id) AS place,
                        count(*) OVER () AS n FROM flat)
           WHERE place > n - 4000 AND place <= n - 50 AND (place - (n - 4000) - 1) % 700 = 0"""
    ),
    "row_number": _flat(
        """SELECT loan_id, book_name, row_number() OVER (ORDER BY book_name, loan_id) AS row_number
           FROM flat"""
    ),
    "every_nth": _with(
        f"""SELECT * FROM (SELECT {_BOOK_COLS},
                                  row_number() OVER (ORDER BY name, id) AS row_number FROM book)
            WHERE row_number > 3 AND (row_number - 1 - 3) % 7 = 0"""
    ),
    "page_count": _flat(
        """SELECT count(*) AS "rows", CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages
           FROM flat WHERE return_date IS NULL"""
    ),
}


def _overlapping(table: str) -> str:
    return f"""SELECT a.id AS loan_id, a.book_id FROM {table} AS a
        WHERE (a.return_date IS NULL OR a.return_date >= a.start_date) AND EXISTS (
            SELECT 1 FROM {table} AS b WHERE b.book_id = a.book_id AND b.id <> a.id
            AND (b.return_date IS NULL OR b.return_date >= b.start_date)
            AND a.start_date < coalesce(b.return_date, DATE '9999-12-31')
            AND b.start_date < coalesce(a.return_date, DATE '9999-12-31'))"""


def _nulls(table: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", id, '{c}' AS \"column\" FROM {source} WHERE {c} IS NULL"
        for c in columns
    )


def _repeated(table: str, source: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", id, count(*) AS n FROM {source} "
        "GROUP BY id HAVING count(*) > 1"
    )


def _orphans(column: str, parent: str, source: str = "bad_loan") -> str:
    return (
        f"SELECT id AS loan_id, '{column}' AS \"column\", {column} AS key FROM {source} "
        f"WHERE {column} NOT IN (SELECT id FROM {parent})"
    )


_NULL_REQUIRED = " UNION ALL ".join(
    [
        _nulls("book", "bad_book", ["id", "name", "year", "author", "genre", "added"]),
        _nulls("client", "bad_client", ["id", "name", "registered", "address"]),
        _nulls("loan", "bad_loan", ["id", "start_date", "end_date", "book_id", "client_id"]),
    ]
)
_ORPHANS = _orphans("book_id", "bad_book") + " UNION ALL " + _orphans("client_id", "bad_client")
_REPEATED = " UNION ALL ".join(
    [_repeated("book", "bad_book"), _repeated("client", "bad_client"), _repeated("loan", "bad_loan")]
)

_CHANGES = """
change_book AS (
    SELECT id AS arrival, CASE WHEN year = 1977 THEN id + (SELECT max(p_partkey) + 1 FROM part) ELSE id END AS id,
           upper(name) AS name, year, CASE WHEN year <> 1978 THEN author END AS author, genre,
           added + (year - 1970) * 5 AS added
    FROM book),
change_client AS (
    SELECT id AS arrival, id, name || ' *' AS name,
           registered + CAST(day(registered) * 9 AS INT) AS registered, lower(address) AS address
    FROM client),
first_by_book AS (SELECT book_id, min(start_date) AS first_start FROM loan GROUP BY 1),
first_by_client AS (SELECT client_id, min(start_date) AS first_start FROM loan GROUP BY 1)"""


def _earlier(day: str, other: str) -> str:
    return f"CAST({day} AS VARCHAR) || ' < ' || CAST({other} AS VARCHAR)"


AUDITS = {
    "overlap_violations": _with(_overlapping("loan")),
    "overlap_violations_as_written": _with(
        # Either loan starts before the other is back, or neither is back.
        """SELECT a.id AS loan_id, a.book_id FROM loan AS a WHERE EXISTS (
               SELECT 1 FROM loan AS b WHERE b.book_id = a.book_id AND b.id <> a.id AND (
                   a.start_date < b.return_date OR b.start_date < a.return_date
                   OR (a.return_date IS NULL AND b.return_date IS NULL)))"""
    ),
    "loan_before_book": _with(
        """SELECT loan.id AS loan_id, book_id, start_date, added
           FROM loan JOIN book ON book_id = book.id WHERE start_date < added"""
    ),
    "loan_before_client": _with(
        """SELECT loan.id AS loan_id, client_id, start_date, registered
           FROM loan JOIN client ON client_id = client.id WHERE start_date < registered"""
    ),
    "book_after_loan": _with(
        _CHANGES,
        """SELECT id, added, first_start FROM change_book JOIN first_by_book ON book_id = id
           WHERE added > first_start""",
    ),
    "client_after_loan": _with(
        _CHANGES,
        """SELECT id, registered, first_start
           FROM change_client JOIN first_by_client ON client_id = id
           WHERE registered > first_start""",
    ),
    "return_before_start": _with(
        _DAMAGED,
        "SELECT id AS loan_id, start_date, return_date FROM bad_loan WHERE return_date < start_date",
    ),
    "due_before_start": _with(
        _DAMAGED,
        "SELECT id AS loan_id, start_date, end_date FROM bad_loan WHERE end_date < start_date",
    ),
    "null_required": _with(_DAMAGED, _NULL_REQUIRED),
    "orphan_loans": _with(_DAMAGED, _ORPHANS),
    "duplicate_ids": _with(_DAMAGED, _REPEATED),
    "audit_all": _with(
        _DAMAGED,
        f"""SELECT 'overlap' AS rule, 'loan' AS "table", loan_id AS id,
                   'book ' || book_id AS detail FROM ({_overlapping("bad_loan")})
            UNION ALL
            SELECT 'loan_before_book', 'loan', bad_loan.id, {_earlier('start_date', 'added')}
            FROM bad_loan JOIN (SELECT DISTINCT id, added FROM bad_book) AS bad_book
            ON book_id = bad_book.id WHERE start_date < added
            UNION ALL
            SELECT 'loan_before_client', 'loan', bad_loan.id,
                   {_earlier('start_date', 'registered')}
            FROM bad_loan JOIN bad_client ON client_id = bad_client.id
            WHERE start_date < registered
            UNION ALL
            SELECT 'return_before_start', 'loan', id, {_earlier('return_date', 'start_date')}
            FROM bad_loan WHERE return_date < start_date
            UNION ALL
            SELECT 'due_before_start', 'loan', id, {_earlier('end_date', 'start_date')}
            FROM bad_loan WHERE end_date < start_date
            UNION ALL SELECT 'null_required', "table", id, "column" FROM ({_NULL_REQUIRED})
            UNION ALL SELECT 'orphan_loan', 'loan', loan_id, "column" || ' ' || key
                      FROM ({_ORPHANS})
            UNION ALL SELECT 'duplicate_id', "table", id, n || ' rows' FROM ({_REPEATED})""",
    ),
}


def _all_findings(book: str, client: str, loan: str) -> str:
    """All rules over three tables; an item that stands twice counts from its latest day."""
    nulls = " UNION ALL ".join(
        [
            _nulls("book", book, ["id", "name", "year", "author", "genre", "added"]),
            _nulls("client", client, ["id", "name", "registered", "address"]),
            _nulls("loan", loan, ["id", "start_date", "end_date", "book_id", "client_id"]),
        ]
    )
    repeated = " UNION ALL ".join([_repeated("book", book), _repeated("client", client), _repeated("loan", loan)])
    orphans = f"{_orphans('book_id', book, loan)} UNION ALL {_orphans('client_id', client, loan)}"
    return f"""
        SELECT 'overlap' AS rule, 'loan' AS "table", loan_id AS id, 'book ' || book_id AS detail
        FROM ({_overlapping(loan)})
        UNION ALL SELECT 'loan_before_book', 'loan', l.id, {_earlier('start_date', 'added')}
        FROM {loan} AS l JOIN (SELECT id, max(added) AS added FROM {book} GROUP BY id) AS b
        ON book_id = b.id WHERE start_date < added
        UNION ALL SELECT 'loan_before_client', 'loan', l.id, {_earlier('start_date', 'registered')}
        FROM {loan} AS l JOIN (SELECT id, max(registered) AS registered FROM {client} GROUP BY id) AS c
        ON client_id = c.id WHERE start_date < registered
        UNION ALL SELECT 'return_before_start', 'loan', id, {_earlier('return_date', 'start_date')}
        FROM {loan} WHERE return_date < start_date
        UNION ALL SELECT 'due_before_start', 'loan', id, {_earlier('end_date', 'start_date')}
        FROM {loan} WHERE end_date < start_date
        UNION ALL SELECT 'null_required', "table", id, "column" FROM ({nulls})
        UNION ALL SELECT 'orphan_loan', 'loan', loan_id, "column" || ' ' || key FROM ({orphans})
        UNION ALL SELECT 'duplicate_id', "table", id, n || ' rows' FROM ({repeated})"""


def _new_id(kind: str, table: str) -> str:
    top = f"(SELECT max(id) + 1 FROM {table})"
    return f"CASE {kind} WHEN 0 THEN id WHEN 1 THEN {top} + id // 2 END"


def _appended(columns: str, id_kind: str, null_checks: str, table: str) -> tuple[str, str]:
    """Of an append to the table of items or borrowers: IDs and reasons, and the table after it."""
    parts = f"""
        batch AS (SELECT id AS arrival, {_new_id(id_kind, table)} AS new_id, {columns} FROM {table}),
        judged AS (SELECT *, CASE {null_checks}
            WHEN new_id IN (SELECT id FROM {table}) THEN 'id taken' END AS reason FROM batch),
        settled AS (SELECT * REPLACE (coalesce(reason, CASE WHEN new_id IS NOT NULL
            AND arrival > min(arrival) FILTER (WHERE reason IS NULL) OVER (PARTITION BY new_id)
            THEN 'id taken' END) AS reason) FROM judged),
        top AS (SELECT greatest((SELECT max(id) FROM {table}),
            (SELECT max(new_id) FROM settled WHERE reason IS NULL)) AS id),
        numbered AS (SELECT * , CASE WHEN new_id IS NULL AND reason IS NULL
               THEN (SELECT id FROM top) + row_number() OVER (
                   PARTITION BY new_id IS NULL AND reason IS NULL ORDER BY arrival)
               ELSE new_id END AS id FROM settled)"""
    names = _TABLE_ROWS[table]
    after = f"SELECT {names} FROM {table} UNION ALL SELECT {names} FROM numbered WHERE reason IS NULL"
    return _with(parts, "SELECT arrival, id, reason FROM numbered"), _with(parts, after)


# Loans of a batch (arrival, id, start_date, end_date, return_date, book_id, client_id, reason),
# passed in arrival order within each item; the spans already accepted are carried along.
_PASS = """
parented AS (
    SELECT batch.*, coalesce(return_date, DATE '9999-12-31') AS last, coalesce(reason, CASE
        WHEN end_date < start_date THEN 'due before start'
        WHEN return_date < start_date THEN 'return before start'
        WHEN added IS NULL THEN 'unknown book' WHEN registered IS NULL THEN 'unknown client'
        WHEN start_date < added THEN 'before book'
        WHEN start_date < registered THEN 'before client' END) AS early_reason
    FROM batch LEFT JOIN book ON book_id = book.id LEFT JOIN client ON client_id = client.id),
fixed AS (
    SELECT *, coalesce(early_reason, CASE WHEN EXISTS (
        SELECT 1 FROM loan AS o WHERE o.book_id = p.book_id AND o.id IS DISTINCT FROM p.id
        AND o.start_date < p.last AND p.start_date < coalesce(o.return_date, DATE '9999-12-31'))
        THEN 'overlaps a loan' END) AS fixed_reason
    FROM parented AS p),
queue AS (
    SELECT arrival, book_id, start_date AS first, last,
           row_number() OVER (PARTITION BY book_id ORDER BY arrival) AS turn
    FROM fixed WHERE fixed_reason IS NULL),
pass AS (
    SELECT arrival, book_id, turn, TRUE AS fits, [{'f': first, 'l': last}] AS held
    FROM queue WHERE turn = 1
    UNION ALL
    SELECT arrival, book_id, turn, fits,
           CASE WHEN fits THEN list_append(held, {'f': first, 'l': last}) ELSE held END
    FROM (SELECT q.arrival, q.book_id, q.turn, q.first, q.last, p.held,
                 len(list_filter(p.held, lambda h: h.f < q.last AND q.first < h.l)) = 0 AS fits
          FROM pass AS p JOIN queue AS q ON q.book_id = p.book_id AND q.turn = p.turn + 1)),
settled AS (
    SELECT fixed.arrival, id, coalesce(fixed_reason,
        CASE WHEN NOT fits THEN 'overlaps the batch' END) AS reason
    FROM fixed LEFT JOIN pass ON pass.arrival = fixed.arrival)"""

# The same for changes of loans that are there, one after the other: the spans of the loans that may
# move are carried along, and an accepted change takes the place of its loan's span.
_PASS_CHANGES = (
    _PASS[: _PASS.index("fixed AS (")]
    + """
moving AS (SELECT DISTINCT id FROM parented WHERE early_reason IS NULL),
still AS (SELECT * FROM loan WHERE id NOT IN (SELECT id FROM moving)),
fixed AS (
    SELECT *, coalesce(early_reason, CASE WHEN EXISTS (
        SELECT 1 FROM still AS o WHERE o.book_id = p.book_id
        AND o.start_date < p.last AND p.start_date < coalesce(o.return_date, DATE '9999-12-31'))
        THEN 'overlaps a loan' END) AS fixed_reason
    FROM parented AS p),
queue AS (
    SELECT arrival, id, book_id, start_date AS first, last,
           row_number() OVER (PARTITION BY book_id ORDER BY arrival) AS turn
    FROM fixed WHERE fixed_reason IS NULL),
pass AS (
    SELECT CAST(NULL AS BIGINT) AS arrival, book_id, CAST(0 AS BIGINT) AS turn, TRUE AS fits,
           list({'id': id, 'f': start_date, 'l': coalesce(return_date, DATE '9999-12-31')}) AS held
    FROM loan WHERE id IN (SELECT id FROM moving) GROUP BY book_id
    UNION ALL
    SELECT arrival, book_id, turn, fits,
           CASE WHEN fits THEN list_append(
               list_filter(held, lambda h: h.id <> id), {'id': id, 'f': first, 'l': last})
               ELSE held END
    FROM (SELECT q.arrival, q.id, q.book_id, q.turn, q.first, q.last, p.held,
                 len(list_filter(p.held,
                     lambda h: h.id <> q.id AND h.f < q.last AND q.first < h.l)) = 0 AS fits
          FROM pass AS p JOIN queue AS q ON q.book_id = p.book_id AND q.turn = p.turn + 1)),
settled AS (
    SELECT fixed.* EXCLUDE (reason), coalesce(fixed_reason,
        CASE WHEN NOT fits THEN 'overlaps the batch' END) AS reason
    FROM fixed LEFT JOIN pass ON pass.arrival = fixed.arrival)"""
)

_LOAN_COLS = _TABLE_ROWS["loan"]


def _changed(batch: str) -> tuple[str, str]:
    """Decisions on changes of loans, and the loans after them."""
    after = f"""SELECT {_LOAN_COLS} FROM settled WHERE reason IS NULL
        UNION ALL SELECT {_LOAN_COLS} FROM loan
        WHERE id NOT IN (SELECT id FROM settled WHERE reason IS NULL)"""
    parts = [batch, _PASS_CHANGES]
    decisions = "SELECT arrival, id, reason FROM settled"
    return _with(*parts, decisions, recursive=True), _with(*parts, after, recursive=True)


_BOOKS = _appended(
    "CASE WHEN year <> 1994 THEN name END AS name, year, author, genre, added",
    "year % 4",
    "WHEN name IS NULL THEN 'null name'",
    "book",
)
_CLIENTS = _appended(
    "name, registered, CASE WHEN address <> 'NATION_3' THEN address END AS address",
    "day(registered) % 4",
    "WHEN address IS NULL THEN 'null address'",
    "client",
)
_LOAN_UPDATES = _changed(
    """
        batch AS (
            SELECT id AS arrival, id, start_date, end_date + 3 AS end_date,
                   least(coalesce(return_date, cut), cut) AS return_date, book_id, client_id,
                   CAST(NULL AS VARCHAR) AS reason
            FROM (SELECT *, start_date + CAST(day(start_date) % 5 AS INT) AS cut FROM loan))"""
)
_RETURNS = _changed(
    """
        batch AS (
            SELECT id AS arrival, id, start_date, end_date, CASE WHEN day(end_date) = 1
                   THEN start_date - 1 ELSE end_date - 5 END AS return_date, book_id, client_id,
                   CASE WHEN return_date IS NOT NULL THEN 'not out' END AS reason
            FROM loan)"""
)
_NEW_LOANS = """
        batch AS (
            SELECT request_id AS arrival, CAST(NULL AS BIGINT) AS id, first_day AS start_date,
                   last_day AS end_date, CASE WHEN day(first_day) <> 31
                   THEN first_day + CAST(42 - (last_day - first_day) AS INT) END AS return_date,
                   book_id, client_id, CAST(NULL AS VARCHAR) AS reason
            FROM request)"""
_NUMBERED_LOANS = """
        numbered AS (SELECT arrival, CASE WHEN reason IS NULL THEN (SELECT max(id) FROM loan)
               + row_number() OVER (PARTITION BY reason IS NULL ORDER BY arrival) END AS id, reason
           FROM settled)"""
_LOANS_AFTER = f"""SELECT {_LOAN_COLS} FROM loan UNION ALL
            SELECT n.id, start_date, end_date, return_date, book_id, client_id
            FROM numbered AS n JOIN batch USING (arrival) WHERE n.reason IS NULL"""
_GONE_BOOKS = "year BETWEEN 1970 AND 1979"
_GONE_CLIENTS = "registered < DATE '1994-09-01'"


def _deleted(table: str, gone: str) -> dict[str, str]:
    """What is left of the loans and of the table itself, and the decisions."""
    key, name = f"{table}_id", f"delete_{table}s"
    top = f"(SELECT max(id) + 1 FROM {table})"
    return {
        name: _with(f"SELECT * FROM loan WHERE {key} NOT IN (SELECT id FROM {table} WHERE {gone})"),
        f"{name}_table": _with(f"SELECT {_TABLE_ROWS[table]} FROM {table} WHERE NOT ({gone})"),
        f"{name}_decisions": _with(
            f"""SELECT id AS arrival, CASE WHEN {gone} THEN id ELSE id + {top} END AS id,
                    CASE WHEN NOT ({gone}) THEN 'unmatched' END AS reason FROM {table}"""
        ),
    }


INTAKE = {
    "clean_rows": _with(
        """
        raw AS (
            SELECT id AS arrival, CASE WHEN p_size % 7 <> 0 THEN id END AS id,
                   CASE WHEN p_size = 13 THEN '' ELSE name END AS name,
                   CASE WHEN p_size IN (21, 23) THEN NULL ELSE year END AS year,
                   CASE WHEN p_size <> 17 THEN author END AS author, genre,
                   CASE WHEN p_size IN (31, 32, 35) THEN NULL WHEN p_size = 33
                        THEN DATE '2024-01-02' WHEN p_size = 34 THEN DATE '2024-03-04'
                        ELSE added END AS added
            FROM book JOIN part ON id = p_partkey)""",
        """SELECT *, CASE WHEN name = '' THEN 'empty name' WHEN year IS NULL THEN 'bad year'
               WHEN author IS NULL THEN 'empty author' WHEN added IS NULL THEN 'bad added'
               END AS reject_reason FROM raw""",
    ),
    "append_books": _BOOKS[0],
    "append_books_table": _BOOKS[1],
    "append_clients": _CLIENTS[0],
    "append_clients_table": _CLIENTS[1],
    "append_loans": _with(
        _REQUESTS, _NEW_LOANS, _PASS, _NUMBERED_LOANS, "SELECT * FROM numbered", recursive=True
    ),
    "append_loans_table": _with(
        _REQUESTS,
        _NEW_LOANS,
        _PASS,
        _NUMBERED_LOANS,
        _LOANS_AFTER,
        recursive=True,
    ),
    "update_books_decisions": _with(
        _CHANGES,
        """SELECT arrival, c.id, CASE WHEN c.author IS NULL THEN 'null author'
               WHEN book.id IS NULL THEN 'unmatched'
               WHEN c.added > first_start THEN 'after a loan' END AS reason
           FROM change_book AS c LEFT JOIN book ON book.id = c.id
           LEFT JOIN first_by_book ON book_id = c.id""",
    ),
    "update_clients_decisions": _with(
        _CHANGES,
        """SELECT arrival, c.id, CASE WHEN c.registered > first_start THEN 'after a loan' END AS reason
           FROM change_client AS c LEFT JOIN first_by_client ON client_id = c.id""",
    ),
    "update_books": _with(
        _CHANGES,
        """
        good AS (
            SELECT c.* FROM change_book AS c JOIN book USING (id) LEFT JOIN first_by_book
            ON book_id = c.id WHERE c.author IS NOT NULL
            AND (first_start IS NULL OR c.added <= first_start))""",
        """SELECT id, name, year, author, genre, added FROM good
           UNION ALL SELECT id, name, year, author, genre, added FROM book
           WHERE id NOT IN (SELECT id FROM good)""",
    ),
    "update_clients": _with(
        _CHANGES,
        """
        good AS (
            SELECT c.* FROM change_client AS c LEFT JOIN first_by_client ON client_id = c.id
            WHERE first_start IS NULL OR c.registered <= first_start)""",
        """SELECT id, name, registered, address FROM good
           UNION ALL SELECT id, name, registered, address FROM client
           WHERE id NOT IN (SELECT id FROM good)""",
    ),
    "update_loans": _LOAN_UPDATES[0],
    "update_loans_table": _LOAN_UPDATES[1],
    "record_returns": _RETURNS[0],
    "record_returns_table": _RETURNS[1],
    **_deleted("book", _GONE_BOOKS),
    **_deleted("client", _GONE_CLIENTS),
    "check_loan_requests": _with(
        _REQUESTS,
        f"""SELECT *, reason IS NULL AS accepted FROM (
            SELECT request.*, CASE WHEN added IS NULL THEN 'unknown book'
                WHEN registered IS NULL THEN 'unknown client'
                WHEN added > first_day THEN 'not in stock' WHEN {_LOANED} THEN 'loaned'
                WHEN registered > first_day THEN 'not registered' END AS reason
            FROM request LEFT JOIN book ON book_id = book.id
            LEFT JOIN client ON client_id = client.id)""",
    ),
}


def _after_append(query: str) -> str:
    """A report over the whole table of loans as it is after a batch."""
    after = f"after_loan AS ({_LOANS_AFTER})"
    parts = [_REQUESTS, _NEW_LOANS, _PASS, _NUMBERED_LOANS, after, _totals("after_loan"), query]
    return _with(*parts, recursive=True)


def _after_delete(query: str) -> str:
    after = f"after_loan AS (SELECT * FROM loan WHERE book_id NOT IN (SELECT id FROM book WHERE {_GONE_BOOKS}))"
    return _with(after, _totals("after_loan"), query)


_LAST_VISITS = f"SELECT {_TOTAL_COLS}, coalesce(seen, registered) AS last_visit FROM total"
_TOTAL_LOANS = f"SELECT {_TOTAL_COLS}, loans FROM total"

CARRIED_ON = {
    "genre_scores_after_append": _after_append("SELECT genre, score FROM genre_total"),
    "last_visit_dates_after_append": _after_append(_LAST_VISITS),
    "total_loans_after_append": _after_append(_TOTAL_LOANS),
    "unreturned_loans_after_append": _after_append(
        f"SELECT {_TOTAL_COLS}, still_out AS loans FROM total WHERE loans = 0 OR still_out > 0"
    ),
    "last_visit_dates_after_delete": _after_delete(_LAST_VISITS),
    "total_loans_after_delete": _after_delete(_TOTAL_LOANS),
    "audit_change": _with(
        _REQUESTS,
        _NEW_LOANS,
        f"""
        new_book AS (
            SELECT id, name, year, author, genre, added FROM book
            UNION ALL SELECT id, name, year, author, genre, added + 700 FROM book WHERE year = 1960),
        new_client AS (
            SELECT id, name, CASE WHEN address <> 'NATION_3' THEN registered END AS registered, address
            FROM client),
        new_loan AS (
            SELECT {_LOAN_COLS} FROM loan
            UNION ALL SELECT -arrival, start_date, end_date, return_date, book_id, client_id FROM batch)""",
        f"""({_all_findings('new_book', 'new_client', 'new_loan')})
            EXCEPT ALL ({_all_findings('book', 'client', 'loan')})""",
    ),
}

ALL: dict[str, str] = {
    **SOURCES_AND_SINKS,
    **SEARCHES,
    **TEXTS,
    **QUERIES,
    **REPORTS,
    **PAGES,
    **AUDITS,
    **INTAKE,
    **CARRIED_ON,
}

"""DuckDB SQL that computes the same tables as the registered queries."""


def all_sql() -> dict[str, str]:
    from oracle import derived_sql, documents_sql, pages_sql

    return {**pages_sql.SQL, **documents_sql.SQL, **derived_sql.SQL}

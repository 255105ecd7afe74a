"""Ready jobs: input tables derived from the given ones, the queries over them, and their DuckDB SQL."""

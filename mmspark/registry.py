"""All registered queries and their SQL."""

from mmspark.plans import q_cdc, q_graph, q_text

QUERIES: dict = q_graph.QUERIES | q_text.QUERIES | q_cdc.QUERIES
ORACLE_SQL: dict = q_graph.SQL | q_text.SQL | q_cdc.SQL

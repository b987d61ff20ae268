"""Training-data operators; nothing else in the package imports them.

``queries.QUERIES`` and ``queries.ORACLE_SQL`` hold their registered forms. Executors must be able to
import the package (``--py-files`` or an installed wheel).
"""

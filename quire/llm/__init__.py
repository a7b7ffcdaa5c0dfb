"""Training-data operators: classifiers, de-duplication, exact search, filters,
tokenization, personal data, chat formatting and source mixing.

``queries.QUERIES`` lists one query per operator, ``oracle.SQL`` the DuckDB SQL
for those that SQL can express. Nothing else in the library imports this
package.
"""

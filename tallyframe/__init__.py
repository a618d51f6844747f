"""Analytics over public-record data (votes, memberships, documents, answers) as Spark DataFrame operators."""

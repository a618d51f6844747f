"""Column functions: rules, text, urls, dates. All are Spark built-ins unless a module says otherwise."""

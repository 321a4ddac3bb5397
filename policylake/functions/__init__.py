"""Row-wise functions: text, links, rules, citizens. All are built-in columns."""

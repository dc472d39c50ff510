"""Plan shapes shared by operators: ordered prefixes, skewed joins, stored intermediates."""

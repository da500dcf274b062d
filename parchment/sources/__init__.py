"""Where rows come from and go to: source trees, archives, landed responses, metadata, term lists, configuration; records and reports."""

"""Where rows live: the write-ahead log, segments and the manifest."""

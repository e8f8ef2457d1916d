"""Where rows come from and go to: XML files, logs, change feeds, snapshots."""

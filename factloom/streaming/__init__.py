"""Nothing streams here: facts are batch snapshots, and no operator has event time, watermark or state."""

"""Line protocol, Prometheus samples, HTML index and percentile charts."""

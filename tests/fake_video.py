"""Decoders, models, trackers and writers for the tests: frame k is the text of k, or the places of walkers."""

import json
import time


class Decoder:
    @staticmethod
    def probe(path):
        return 0, 64, 48, 10

    @staticmethod
    def read(path, first, stop):
        return (str(k).encode() for k in range(first, stop))


decoder = Decoder()


def load():
    def model(images, confidence, iou, image_size, agnostic_nms, device, half):
        assert (device, half) == ("cpu", False)
        return [[(float(i), 0.0, float(i) + 2, 4.0, 0.5, None)] if int(i) % 2 else [] for i in images]

    return model


def start(name):
    """A tracker that numbers the frames it has seen."""
    seen = []

    def tracker(image, **settings):
        seen.append(int(image))
        assert seen == sorted(seen) and name == "bytetrack.yaml"
        return [(0.0, 0.0, 2.0, 2.0, 0.9, len(seen))] if int(image) % 3 else None

    return tracker


class Writer:
    def __init__(self, folder, video, *size):
        self.path, self.lines = f"{folder}/{video}", [str(size)]

    def write(self, image, marks, texts):
        self.lines.append(f"{image.decode()} {[m['label'] for m in marks]} {[t['text'] for t in texts]}")

    def close(self):
        with open(self.path, "w") as out:
            out.write("\n".join(self.lines))


class Growing(Decoder):
    """As many frames as the file of the path says."""

    @staticmethod
    def probe(path):
        with open(path) as f:
            return 0, 64, 48, int(f.read())


growing = Growing()


class Walkers(Decoder):
    """Frame k is the places of three walkers, JSON; two of them are missing now and then."""

    @staticmethod
    def probe(path):
        return 25, 640, 480, 60

    @staticmethod
    def read(path, first, stop):
        for k in range(first, stop):
            yield json.dumps([[10.0 + 200 * i + 2 * k, 50.0 + 90 * i + k] for i in range(3) if k == 0 or (k + 5 * i) % 11 > 1]).encode()


walkers = Walkers()


class WalkerStream(Walkers):
    """As many of these frames as the file of the path says."""

    @staticmethod
    def probe(path):
        with open(path) as f:
            return 25, 640, 480, int(f.read())


walker_stream = WalkerStream()


def walker_model():
    def model(images, **settings):
        time.sleep(0.3)
        return [[(x - 1, y - 2, x + 1, y + 2, 0.9, None) for x, y in json.loads(i)] for i in images]

    return model


class WalkerTracker:
    """Numbers what it sees by how often it was called; its state can be saved."""

    def __init__(self, name="bytetrack.yaml"):
        self.calls = 0

    def __call__(self, image, **settings):
        self.calls += 1
        found = [(x - 1, y - 2, x + 1, y + 2, 0.5 + i / 10, self.calls) for i, (x, y) in enumerate(json.loads(image))]
        return [*found, (0.0, 0.0, 2.0, 2.0, 0.99, None), *(found[:1])]

    def save(self):
        return str(self.calls).encode()

    def restore(self, saved):
        self.calls = int(saved)


class Segment(Writer):
    """A writer of one segment; its name is its path."""

    def __init__(self, folder, video, segment, *size):
        super().__init__(folder, f"{video}-{segment}", *size)

    def close(self):
        super().close()
        return self.path


def joined(folder, video, names):
    lines = []
    for n in names:
        with open(n) as f:
            head, *rest = f.read().split("\n")
        lines += rest if lines else [head, *rest]
    with open(f"{folder}/{video}", "w") as out:
        out.write("\n".join(lines))
    return f"{folder}/{video}"
